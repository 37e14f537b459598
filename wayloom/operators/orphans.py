"""References to records that do not exist.

Parent keys are compressed to runs of successive integers. A first aggregation brings SLOTS neighbouring
keys together in a row, with the last version and first appearance of each; of that only the runs go
on: where they begin and end, whether their keys are deleted, and the latest first appearance among
them. They are shuffled by block, merged, and each reference looks at the run that starts last before
it (an as-of match). A reference beyond the end of that run, or before any run of its block, has no
parent; one that is not older than the run's latest key did not come too early; only for the others is
the key itself looked up in the rows of the first aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a key below its row of the first aggregation, and below the block in which runs and references meet.
SLOT_BITS, BLOCK_BITS = 3, 10
SLOTS = 1 << SLOT_BITS
#: States of a slot and of a run.
_NONE, _THERE, _DELETED = 0, 1, 2


def parent_rows(df: DataFrame, ref_type: str) -> DataFrame:
    """(ref_type, key, last, first) of each row of a parent table (id, version, visible, date): last is twice the version, and one
    more if the row is a deletion; first, of a first version, its date in microseconds. Null ids are left out, null visible counts
    as visible, null versions as the lowest."""
    version = F.coalesce(F.col("version"), F.lit(-(2**31))).cast("long")
    return df.where(F.col("id").isNotNull()).select(
        F.lit(ref_type).alias("ref_type"), F.col("id").alias("key"), (version * 2 + F.when(~F.col("visible"), 1).otherwise(0)).alias("last"),
        F.when(F.col("version") == 1, F.unix_micros("date")).alias("first"),
    )


def key_slots(parents: DataFrame) -> DataFrame:
    """(ref_type, slots, states, firsts): SLOTS neighbouring keys a row, from one aggregation with partial sums over the rows of all
    parent tables. A key is deleted if its row with the highest version is a deletion."""
    slot = F.col("key").bitwiseAND(SLOTS - 1)
    aggs = [F.max(F.when(slot == i, F.col("last"))).alias(f"l{i}") for i in range(SLOTS)]
    aggs += [F.min(F.when(slot == i, F.col("first"))).alias(f"f{i}") for i in range(SLOTS)]
    state = lambda i: F.when(F.col(f"l{i}").isNull(), _NONE).when(F.pmod(f"l{i}", F.lit(2)) == 1, _DELETED).otherwise(_THERE)
    slots = F.shiftright("key", SLOT_BITS)
    # Spark filters the side of a join in this way; done for all uses, their plans are equal and share one shuffle.
    rows = parents.where(slots.isNotNull()).groupBy("ref_type", slots.alias("slots")).agg(*aggs)
    return rows.select("ref_type", "slots", F.array(*map(state, range(SLOTS))).alias("states"), F.array(*(f"f{i}" for i in range(SLOTS))).alias("firsts"))


def block_of(key: Column) -> Column:
    return F.shiftright(key, BLOCK_BITS)


def key_runs(slots: DataFrame) -> DataFrame:
    """(ref_type, block, start, end, deleted, latest): runs of successive keys in the same state, cut at block borders.

    latest is the latest first appearance of a run's keys, null if none is known. What is shuffled are the runs within each row of slots.
    """
    at = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    begins = F.filter(at, lambda i: (F.get("states", i) != _NONE) & ((i == 0) | (F.get("states", i - 1) != F.get("states", i))))

    def run(i: Column) -> Column:
        other = F.filter(at, lambda j: (j > i) & (F.get("states", j) != F.get("states", i)))
        end = F.coalesce(F.get(other, 0), F.lit(SLOTS)) - 1
        base = F.shiftleft("slots", SLOT_BITS)
        return F.struct(
            (base + i).alias("start"), (base + end).alias("end"), (F.get("states", i) == _DELETED).alias("deleted"),
            F.array_max(F.slice("firsts", i + 1, end - i + 1)).alias("latest"),
        )

    small = slots.select("ref_type", F.inline(F.transform(begins, run))).withColumn("block", block_of(F.col("start")))
    w = Window.partitionBy("ref_type", "block").orderBy("start")
    goes_on = (F.lag("end").over(w) + 1 == F.col("start")) & (F.lag("deleted").over(w) == F.col("deleted"))
    return (
        small.withColumn("head", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("start")))
        .withColumn("head", F.last("head", ignorenulls=True).over(w))
        .groupBy("ref_type", "block", F.col("head").alias("start"))
        .agg(F.max("end").alias("end"), F.first("deleted").alias("deleted"), F.max("latest").alias("latest"))
    )


def match_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """The keys (ref_type, ref_id, since: the earliest referring time) that are or may be orphans, with state: missing, deleted, or late
    if the earliest reference precedes the latest key of its run.

    Blocks hold at most 2**BLOCK_BITS keys of either side: no window group grows with the input.
    """
    both = keys.select(
        "ref_type", block_of(F.col("ref_id")).alias("block"), F.col("ref_id").alias("at"), F.lit(1).alias("kind"), "since",
        F.lit(None).cast("struct<end:bigint,deleted:boolean,latest:bigint>").alias("run"),
    ).unionByName(
        runs.select("ref_type", "block", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("since"), F.struct("end", "deleted", "latest").alias("run"))
    )
    w = Window.partitionBy("ref_type", "block").orderBy("at", "kind")
    beyond = F.col("run").isNull() | (F.col("at") > F.col("run.end"))
    state = F.when(beyond, "missing").when(F.col("run.deleted"), "deleted").when(F.col("run.latest") > F.col("since"), "late")
    return (
        both.withColumn("run", F.last("run", ignorenulls=True).over(w))
        .where("kind = 1")
        .select("ref_type", F.col("at").alias("ref_id"), "since", state.alias("state"))
        .where(F.col("state").isNotNull())
    )


def orphan_references(refs: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """Every reference whose target is missing, deleted or came later.

    refs: (src, src_id, ref_type, ref_id, date), each reference once; parents: as of parent_rows, one
    for each table. Returns (src, src_id, ref_type, ref_id, state, period).

    A key that many rows refer to is matched once: the keys are aggregated before the shuffle.
    What was found goes back to the references by a join on the key, in which Spark splits the
    partition of a hot key. References with null ref_id are no references; with a null type they
    have no table and are left out; with a type that parents do not have they are missing. A null date is never too early, its period
    is ``none``. A reference given twice is returned twice.
    """
    at = F.unix_micros("date")
    refs = refs.where(F.col("ref_id").isNotNull() & F.col("ref_type").isNotNull()).select("src", "src_id", "ref_type", "ref_id", "date")
    keys = refs.groupBy("ref_type", "ref_id").agg(F.min(at).alias("since"))
    slots = key_slots(reduce(DataFrame.unionByName, parents))
    met = match_runs(keys, key_runs(slots)).withColumn("slots", F.shiftright("ref_id", SLOT_BITS))
    # Both uses of the slots read all of their columns, so that Spark makes and shuffles them once.
    slot = F.col("ref_id").bitwiseAND(SLOTS - 1).cast("int")
    first = F.when(F.get("states", slot) == _THERE, F.get("firsts", slot))
    bad = (
        met.join(slots, ["ref_type", "slots"], "left")
        .select("ref_type", "ref_id", "state", F.when(F.col("state") == "late", first).alias("first"), "since")
        .where((F.col("state") != "late") | (F.col("first") > F.col("since")))
        .drop("since")
    )
    day = F.date_from_unix_date(F.floor(at / F.lit(86_400_000_000)).cast("int"))
    return (
        refs.join(bad, ["ref_type", "ref_id"])
        .where((F.col("state") != "late") | (F.col("first") > at))
        .select(
            "src", "src_id", "ref_type", "ref_id", "state",
            F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none")).alias("period"),
        )
    )


def way_references(ways: DataFrame) -> DataFrame:
    """Distinct node references of current, visible ways; repeated ones go before the explode, without a shuffle."""
    return ways.select(
        F.lit("ways").alias("src"), F.col("id").alias("src_id"), "date",
        F.lit("N").alias("ref_type"), F.explode(F.array_distinct("nodes")).alias("ref_id"),
    )


def member_references(relations: DataFrame) -> DataFrame:
    """Distinct member references of current, visible relations, types in upper case; only N, W and R are types.

    Ids are made distinct by type: on plain numbers that takes a hash set, on structs every pair of them.
    """

    def ids(kind: str) -> Column:
        some = F.filter("members", lambda m: F.upper(m["type"]) == kind)
        return F.struct(F.lit(kind).alias("ref_type"), F.array_distinct(F.transform(some, lambda m: m["id"])).alias("ids"))

    return (
        relations.select("id", "date", F.inline(F.array(*(ids(k) for k in "NWR"))))
        .select(F.lit("relations").alias("src"), F.col("id").alias("src_id"), "date", "ref_type", F.explode("ids").alias("ref_id"))
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """References and distinct missing keys per referring table and period."""
    return found.groupBy("src", "period", "ref_type", "state").agg(
        F.count(F.lit(1)).alias("refs"), F.countDistinct("ref_id").alias("keys")
    )
