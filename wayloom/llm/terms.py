"""Frequency of every distinct term, in occurrences and in records, by suffix-sorted n-gram counting.

Each sequence of a record gives its suffixes, truncated to n terms. Sorted in reverse lexicographic
order, all n-grams that share a prefix are neighbours, and one pass with a stack adds up every prefix.

Records are counted without sets of ids: of a record's sorted suffixes, each one is marked with the
number of leading terms that it shares with the one before it (``shared``); the record is new only to
the prefixes longer than that. So equal (suffix, shared) pairs are added up before the shuffle, which
leaves distinct suffixes only, whatever share of the rows a term has. They are routed by ranges of the
sorted order, first term first; where a border runs through a term, its prefixes come out of both sides
and are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.session import cut

GRAMS = "grp string, gram array<string>, occurrences bigint, records bigint"


def _shared(a: Column, b: Column, n: int) -> Column:
    """Number of leading terms that two suffixes have in common, up to n."""
    total, so_far = F.lit(0), F.lit(True)
    for k in range(n):
        so_far = so_far & (F.size(a) > k) & (F.size(b) > k) & F.get(a, k).eqNullSafe(F.get(b, k))
        total = total + so_far.cast("int")
    return total


def _suffixes(sequences: Column, n: int, anchored: bool) -> Column:
    """All truncated suffixes of a record's sequences, sorted; null terms end no sequence, they are dropped."""
    clean = F.transform(F.filter(sequences, lambda s: s.isNotNull()), lambda s: F.array_compact(s))
    clean = F.filter(clean, lambda s: F.size(s) > 0)
    if anchored:
        return F.array_sort(F.transform(clean, lambda s: F.slice(s, 1, n)))
    starts = lambda s: F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.slice(s, i, F.lit(n)))
    return F.array_sort(F.flatten(F.transform(clean, starts)))


def _stack_pass(n: int):
    """Adds up every prefix of the sorted suffixes; the empty prefix of a group has its occurrences of all suffixes and its records."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[str] = []
        occ, rec = [0] * (n + 1), [0] * (n + 1)
        group, first, out = None, None, []

        def pop(to: int, last: bool) -> None:
            """Leaves the prefixes longer than to, with -1 the group too: each is complete, unless it runs on in a neighbouring partition."""
            while len(stack) > max(to, 0):
                k = len(stack)
                edge = last or (first is not None and first[0] == group and first[1][:k] == stack)
                out.append((group, list(stack), occ[k], rec[k], edge))
                occ[k - 1] += occ[k]
                rec[k - 1] += rec[k]
                occ[k] = rec[k] = 0
                stack.pop()
            if to < 0 and occ[0]:
                out.append((group, [], occ[0], rec[0], True))
                occ[0] = rec[0] = 0

        def flush() -> pd.DataFrame:
            nonlocal out
            rows, out = out, []
            return pd.DataFrame(rows, columns=["grp", "gram", "occurrences", "records", "edge"])

        for part in parts:
            for g, suffix, shared, count in zip(part["grp"], part["suffix"], part["shared"], part["count"]):
                suffix, shared, count = list(suffix), int(shared), int(count)
                if first is None:
                    group, first = g, (g, suffix)
                if g != group:
                    pop(-1, False)
                    group = g
                same = 0
                while same < len(stack) and same < len(suffix) and stack[same] == suffix[same]:
                    same += 1
                pop(same, False)
                stack.extend(suffix[same:])
                k = len(suffix)
                occ[k] += count
                rec[k] += count
                if shared >= 0:
                    rec[shared] -= count
            if len(out) >= 10_000:
                yield flush()
        pop(-1, True)
        if out:
            yield flush()

    return run


def count_grams(records: DataFrame, n: int, anchored: bool = False, totals: bool = False) -> DataFrame:
    """(grp, gram, occurrences, records) of every n-gram of up to n terms.

    records: (grp, sequences: array of arrays of terms), one row a record; groups are counted by
    themselves. anchored: only grams at the start of a sequence. totals: also a row with the empty gram
    for each group, which has its suffixes and the records that have any. Null sequences and null terms
    are left out, a null group is a group. No row is dropped and no count is capped.

    The distinct suffixes are written once before they are range-sorted, and what the stack gives once
    after: both are read twice.
    """
    w = _suffixes(F.col("sequences"), n, anchored)
    rows = records.select("grp", w.alias("all")).where(F.size("all") > 0)
    pairs = F.transform(
        "all",
        lambda s, i: F.struct(
            s.alias("suffix"), F.when(i == 0, -1).otherwise(_shared(s, F.get("all", i - 1), n)).alias("shared")
        ),
    )
    counted = cut(rows.select("grp", F.inline(pairs)).groupBy("grp", "suffix", "shared").count())
    routed = counted.repartitionByRange(F.col("grp").asc(), F.col("suffix").asc()).sortWithinPartitions(
        F.col("grp").asc(), F.col("suffix").desc()
    )
    grams = cut(routed.mapInPandas(_stack_pass(n), GRAMS + ", edge boolean"))
    edges = grams.where("edge").groupBy("grp", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    out = grams.where("NOT edge").drop("edge").unionByName(edges)
    return out if totals else out.where(F.size("gram") > 0)


def tag_terms(tags: Column) -> Column:
    """[key, term] of a tag map: keys trimmed and in lower case, values split at ``;``, parts likewise, empty ones left out."""
    entries = F.filter(F.map_entries(tags), lambda e: e["value"].isNotNull())
    clean = lambda c: F.lower(F.trim(c))
    parts = lambda e: F.filter(F.transform(F.split(e["value"], ";"), clean), lambda p: p != "")
    return F.flatten(F.transform(entries, lambda e: F.transform(parts(e), lambda p: F.array(clean(e["key"]), p))))


def mark_terms(records: DataFrame, rare: int, common: float) -> DataFrame:
    """(grp, gram, occurrences, records, mark) of the two-term grams; sequences have two terms at most.

    mark rare: in at most ``rare`` records; common: in at least the share ``common`` of the records
    that have any; null: neither. A term that is both (in a tiny group) has a row for each.
    """
    all_ = count_grams(records, 2, totals=True)
    totals = all_.where(F.size("gram") == 0).select(F.col("grp").alias("of"), F.col("records").alias("total"))
    grams = all_.where(F.size("gram") == 2)
    marks = F.array_compact(
        F.array(
            F.when(F.col("records") <= rare, "rare"),
            F.when(F.col("records") >= F.lit(common) * F.col("total") - 1e-9, "common"),
        )
    )
    return grams.join(totals, F.col("grp").eqNullSafe(F.col("of"))).select("grp", "gram", "occurrences", "records", F.explode_outer(marks).alias("mark"))
