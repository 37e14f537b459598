"""Import of map data from the command line: a full file into a folder, or diffs onto it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from wayloom.plans.pipeline import Pipeline
from wayloom.sources import opl
from wayloom.sources.files import objects, state_date
from wayloom.streaming.replication import catch_up


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="wayloom", description=__doc__)
    p.add_argument("folder", help="folder of the tables")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("-i", "--import", dest="full", metavar="FILE", help="full file: .opl, .osm, .osm.pbf, also .gz and .bz2")
    what.add_argument("-c", "--change", metavar="FILE", help="change file")
    what.add_argument("-r", "--replicate", metavar="FOLDER", help="folder of numbered diffs")
    p.add_argument("-s", "--sequence", type=int, help="sequence of the file")
    p.add_argument("-m", "--max-kb", type=int, default=51_200, help="diffs of a run, in kB")
    p.add_argument("-t", "--tagged-nodes", action="store_true", help="only nodes with tags become rows; places of all go to the table location")
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    pipeline = Pipeline(spark, o.folder, **({"locations": True} if o.tagged_nodes else {}))
    if o.full:
        found = objects(spark, o.full)
        places = {"location": opl.locations(found).repartitionByRange("id").sortWithinPartitions("id")} if o.tagged_nodes else {}
        pipeline.load(opl.base_tables(found, not o.tagged_nodes) | places, o.sequence)
    elif o.change:
        pipeline.apply(opl.batches(objects(spark, o.change), not o.tagged_nodes), o.sequence, state_date(spark, o.change))
    else:
        print("applied:", *catch_up(pipeline, o.replicate, o.max_kb, not o.tagged_nodes))
    return 0


def run() -> int:
    return main(sys.argv[1:])


if __name__ == "__main__":
    sys.exit(run())
