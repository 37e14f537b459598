"""Diffs that arrive one after the other, applied to a pipeline in order and once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.plans.pipeline import Pipeline
from wayloom.sources import opl
from wayloom.sources.files import LISTED, list_diffs, objects, state_date

#: Diffs whose names come to the driver at once.
PAGE = 1_000


def catch_up(pipeline: Pipeline, folder: str, max_kb: int | None = 1024, keep_empty_nodes: bool = True) -> list[int]:
    """Applies the diffs of a folder that come after the pipeline's sequence, in order, up to max_kb of them but one at least.

    Diffs are text or XML, packed or not, numbered by their names or nested as 004/600/123. Each is read
    once; its date is that of its state file. A diff that follows a gap waits until the gap is closed.
    """
    spark, total, done = pipeline.spark, 0, []
    while True:
        known = pipeline.status.get_sequence()
        if known is None:
            raise ValueError("the pipeline has no sequence to go on from")
        fresh = list_diffs(spark, folder).where(F.col("sequence") > known)
        page = fresh.groupBy("sequence").agg(F.min(F.struct("path", "size")).alias("f")).orderBy("sequence").limit(PAGE).select("sequence", "f.*").collect()
        for r in page:
            total += r["size"]
            if r.sequence != known + 1 or (max_kb is not None and done and total > max_kb * 1024):
                return done
            pipeline.apply(opl.batches(objects(spark, r.path), keep_empty_nodes), r.sequence, state_date(spark, r.path))
            known = r.sequence
            done.append(known)
        if len(page) < PAGE:
            return done


def stream(
    spark: SparkSession, pipeline: Pipeline, folder: str, checkpoint: str, files_per_batch: int = 16,
    after: Callable[[list[int]], None] | None = None, keep_empty_nodes: bool = True,
):
    """A streaming query over a folder of diffs: files that arrive make the pipeline catch up.

    A batch that runs again after a failure finds its sequences applied and does nothing.
    """
    files = spark.readStream.format("binaryFile").schema(LISTED).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def batch(_: DataFrame, __: int) -> None:
        done = catch_up(pipeline, folder, None, keep_empty_nodes)
        if after:
            after(done)

    return files.select("path", "length").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
