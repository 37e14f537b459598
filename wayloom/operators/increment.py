"""Processing only new or changed records.

What has been processed stands in a manifest of input units with size and checksum. A run lists the
units as they are now, takes those that the manifest does not hold in just this form (an anti-join),
reads them alone, writes its output under the number of its batch and commits manifest and output
together, by one marker. A failure before the marker leaves the old state: the next run has the same
number, writes over what was left behind and reads nothing of it.

Units are files in a folder (IncrementalFolder), or, for change feeds kept as tables, the diffs:
the rows of one feed and sequence (FeedIncrement).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.session import cut

#: Parts whose flags share a column of bits.
MASK_PARTS = 62
#: Files of one batch of a folder; more files make more batches.
PAGE_FILES = 10_000


class BatchLog:
    """Numbered batches in a folder: <kind>/batch=<number> for each kind of rows, commits/<number> for those that count.

    Only one run at a time may write; of two, the second one's commit fails, as markers are not written over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def next(self) -> int:
        """The number of the next batch, which is that of the committed ones."""
        fs, p = self._fs(f"{self.folder}/commits")
        return len([s for s in fs.listStatus(p) if s.getPath().getName().isdigit()]) if fs.exists(p) else 0

    def write(self, kind: str, rows: DataFrame) -> None:
        """Writes rows of the next batch, over those of a run that failed."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={self.next()}")

    def read(self, kind: str, schema: str, before: int | None = None) -> DataFrame:
        """The rows of the committed batches, or of those before a number, with their batch."""
        fs, p = self._fs(f"{self.folder}/{kind}")
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema + ", batch int")
        rows = self.spark.read.schema(schema + ", batch int").parquet(f"{self.folder}/{kind}")
        return rows.where(F.col("batch") < (self.next() if before is None else before))

    def commit(self) -> int:
        number = self.next()
        fs, p = self._fs(f"{self.folder}/commits/{number:010d}")
        fs.create(p, False).close()
        return number


# Feeds


def latest_marks(status: DataFrame) -> DataFrame:
    """(part, sequence, date) of each part: its row with the highest sequence among those with
    state ok and a sequence, of several the latest date; nulls for a part without such a row.
    Rows with a null part belong to no part."""
    good = (F.col("state") == "ok") & F.col("sequence").isNotNull()
    mark = F.max(F.when(good, F.struct("sequence", "date"))).alias("mark")
    return status.where(F.col("part").isNotNull()).groupBy("part").agg(mark).select("part", "mark.sequence", "mark.date")


def feed_rows(feeds: dict[str, DataFrame]) -> DataFrame:
    """The deliveries of all feeds: (feed, id, version, sequence, date)."""
    own = [F.col("id").cast("long").alias("id"), F.col("version").cast("int").alias("version"), F.col("sequence").cast("int").alias("sequence"), "date"]
    each = [df.select(F.lit(name).alias("feed"), *own) for name, df in feeds.items()]
    return reduce(DataFrame.unionByName, each)


def _form(name: str, seen: Column | None = None) -> list[Column]:
    """Size and checksum of a unit, or of its rows that were seen: they do not depend on the order of rows, and repeats count."""
    row = F.xxhash64("id", "version", F.unix_micros("date"))
    row = row if seen is None else F.when(seen, row)
    mixed = F.xxhash64(F.sum(F.pmod(row, F.lit(2**31))), F.bit_xor(row))
    return [F.count(row).alias(f"size{name}"), mixed.alias(f"checksum{name}")]


def _reached(mark) -> Column:
    """Whether a delivery has sequence and date both not above the mark's; nulls are not."""
    if mark["sequence"] is None or mark["date"] is None:
        return F.lit(False)
    return F.coalesce((F.col("sequence") <= mark["sequence"]) & (F.col("date") <= F.lit(mark["date"])), F.lit(False))


def _bit(number: int) -> Column:
    return F.lit(1 << number % MASK_PARTS).cast("long")


def _masks(flags: list[Column]) -> list[Column]:
    """Columns m0, m1 and so on with a bit for each flag."""
    zero = F.lit(0).cast("long")
    out = []
    for at in range(0, len(flags), MASK_PARTS):
        bits = [F.when(f, _bit(k)).otherwise(zero) for k, f in enumerate(flags[at : at + MASK_PARTS])]
        out.append(reduce(lambda a, b: a.bitwiseOR(b), bits).alias(f"m{at // MASK_PARTS}"))
    return out


class FeedIncrement:
    """Brings every change of a feed to every part once.

    A change is one (feed, id, version), however often it is delivered. The state holds, by batch, the
    manifest (part, feed, sequence, size, checksum) and the output (feed, id, version, a bit for each
    part that gets it). A run reads the rows of those units that are not in a part's manifest in their
    present form, and drops the changes that an earlier batch brought to the part: a unit becomes
    pending again as a whole when rows come late. Null ids, versions and times are values like others.
    Parts are few and come to the driver, by name and mark.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, BatchLog(spark, folder)

    def parts(self) -> list[str]:
        rows = self.log.read("parts", "number int, part string").select("number", "part").distinct().orderBy("number").collect()
        return [r.part for r in rows]

    @staticmethod
    def listing(feeds: dict[str, DataFrame]) -> DataFrame:
        """(feed, sequence, size, checksum) of the units as they are now."""
        return feed_rows(feeds).groupBy("feed", "sequence").agg(*_form(""))

    def adopt(self, feeds: dict[str, DataFrame], status: DataFrame) -> DataFrame:
        """The first batch: the state as the last successful run of each part in a status table left it. Returns the listing.

        A part's run saw the deliveries whose sequence and date are both not above its mark; a part
        without a mark saw none. The units as they are and as each part saw them come from one
        aggregation over the feeds, the changes seen from another.
        """
        marks = sorted(latest_marks(status).collect(), key=lambda m: m["part"])
        rows = feed_rows(feeds)
        seen = [_reached(m) for m in marks]
        forms = [c for k, s in enumerate(seen) for c in _form(str(k), s)]
        units = cut(rows.groupBy("feed", "sequence").agg(*_form(""), *forms))
        form = lambda k: F.struct(F.lit(k).alias("part"), F.col(f"size{k}").alias("size"), F.col(f"checksum{k}").alias("checksum"))
        known = units.select("feed", "sequence", F.inline(F.array(*map(form, range(len(marks)))))) if marks else None
        self.log.write("parts", self.spark.createDataFrame([(k, m["part"]) for k, m in enumerate(marks)], "number int, part string"))
        if known is not None:
            self.log.write("manifest", known.where("size > 0").select("part", "feed", "sequence", "size", "checksum"))
            masks = _masks(seen)
            ledger = rows.select("feed", "id", "version", *masks).where(" OR ".join(f"m{i} != 0" for i in range(len(masks))))
            self.log.write("output", ledger.groupBy("feed", "id", "version").agg(*(F.bit_or(f"m{i}").alias(f"m{i}") for i in range(len(masks)))))
        self.log.commit()
        return units.select("feed", "sequence", "size", "checksum")

    def manifest(self) -> DataFrame:
        """(part, feed, sequence, size, checksum): the form in which each part's last batch with the unit saw it."""
        rows = self.log.read("manifest", "part int, feed string, sequence int, size bigint, checksum bigint")
        last = F.max_by(F.struct("size", "checksum"), "batch").alias("form")
        return rows.groupBy("part", "feed", "sequence").agg(last).select("part", "feed", "sequence", "form.*")

    def pending(self, listing: DataFrame, parts: int) -> DataFrame:
        """(part, feed, sequence, size, checksum) of the units that are new or changed for a part."""
        every = listing.withColumn("part", F.explode(F.array(*map(F.lit, range(parts)))))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("part", "feed", "sequence", "size", "checksum")]
        left = every.alias("l").join(self.manifest().alias("m"), reduce(lambda a, b: a & b, same), "left_anti")
        return left.select("part", "feed", "sequence", "size", "checksum")

    def run(self, feeds: dict[str, DataFrame], listing: DataFrame | None = None) -> int | None:
        """One run; returns its batch, None if nothing was pending. listing: one that was just made."""
        parts, number = self.parts(), self.log.next()
        if not parts:
            return None
        listing = self.listing(feeds) if listing is None else listing
        self.log.write("manifest", self.pending(listing, len(parts)))
        todo = self.log.read("manifest", "part int, feed string, sequence int", number + 1).where(F.col("batch") == number)
        if todo.isEmpty():
            return None
        words = [f"m{i}" for i in range(-(-len(parts) // MASK_PARTS))]
        units = todo.groupBy(F.col("feed").alias("f"), F.col("sequence").alias("s")).agg(
            *(F.bit_or(c).alias(n) for n, c in zip(words, _masks([F.col("part") == k for k in range(len(parts))])))
        )
        rows = feed_rows(feeds).join(units, (F.col("feed") == F.col("f")) & F.col("sequence").eqNullSafe(F.col("s")))
        key, zero = ["feed", "id", "version"], F.lit(0).cast("long")
        fresh = rows.select(*key, *words, *(zero.alias(f"was_{n}") for n in words))
        before = self.delivered_masks(len(parts)).select(*key, *(zero.alias(n) for n in words), *(F.coalesce(n, zero).alias(f"was_{n}") for n in words))
        both = fresh.unionByName(before).groupBy(*key).agg(*(F.bit_or(n).alias(n) for n in [*words, *(f"was_{n}" for n in words)]))
        left = both.select(*key, *(F.col(n).bitwiseAND(F.bitwise_not(f"was_{n}")).alias(n) for n in words))
        self.log.write("output", left.where(" OR ".join(f"{n} != 0" for n in words)))
        return self.log.commit()

    def delivered_masks(self, parts: int) -> DataFrame:
        words = ", ".join(f"m{i} bigint" for i in range(-(-parts // MASK_PARTS)))
        return self.log.read("output", f"feed string, id bigint, version int, {words}")

    def delivered(self, batch: int | None) -> DataFrame:
        """(part, feed, id, version) that a batch brought; of None, nothing."""
        parts = self.parts()
        if batch is None or not parts:
            return self.spark.createDataFrame([], "part string, feed string, id bigint, version int")
        named = F.array(*(F.when(F.col(f"m{k // MASK_PARTS}").bitwiseAND(_bit(k)) != 0, F.lit(p)) for k, p in enumerate(parts)))
        rows = self.delivered_masks(len(parts)).where(F.col("batch") == batch)
        return rows.select(F.explode(F.array_compact(named)).alias("part"), "feed", "id", "version")


def pending_changes(feeds: dict[str, DataFrame], status: DataFrame, folder: str) -> DataFrame:
    """(part, feed, id, version): the changes that each part's last successful run has not handled.

    The state in folder, which must be new, is set up from the status table; then one run brings what
    is pending. Parts without a mark get every change; without parts or changes the result is empty.
    """
    increment = FeedIncrement(status.sparkSession, folder)
    listing = increment.adopt(feeds, status)
    return increment.delivered(increment.run(feeds, listing))


# Files


def plain_path(uri: Column) -> Column:
    """A path as the listing has it, from the encoded address in ``_metadata.file_path``."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


class IncrementalFolder:
    """Runs over the files of a folder that are new or changed since the last committed run.

    A path counts in the form of its last committed batch: a file that changes and changes back is
    pending both times, and what was made of its older forms is no longer part of the result. Files
    that have gone keep theirs. Listing and checksums are made by tasks; a batch has PAGE_FILES files
    at most, so that no run's list of files is held as a whole.
    """

    def __init__(self, spark: SparkSession, folder: str, state: str, page: int = PAGE_FILES):
        self.spark, self.folder, self.page, self.log = spark, folder, page, BatchLog(spark, state)

    def listing(self) -> DataFrame:
        """(path, size, checksum) of every file; the checksum is made in pieces of 8 MB, never of a whole file at once."""

        def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow import fs as afs

            for part in parts:
                sums = []
                for path in part["path"]:
                    where, name = afs.FileSystem.from_uri(path) if "://" in path else (afs.LocalFileSystem(), path.removeprefix("file:"))
                    h = hashlib.sha256()
                    with where.open_input_stream(name, compression=None) as f:
                        while piece := f.read(8 << 20):
                            h.update(piece)
                    sums.append(h.hexdigest())
                yield part.assign(checksum=sums)

        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        paths = files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.col("length").alias("size"))
        return paths.mapInPandas(digest, "path string, size bigint, checksum string")

    def manifest(self) -> DataFrame:
        """(path, size, checksum, latest): each path in its last committed form, with the batch of that."""
        rows = self.log.read("manifest", "path string, size bigint, checksum string")
        return rows.groupBy("path").agg(F.max_by(F.struct("size", "checksum", "batch"), "batch").alias("m")).select("path", "m.size", "m.checksum", F.col("m.batch").alias("latest"))

    def pending(self) -> DataFrame:
        return self.listing().join(self.manifest(), ["path", "size", "checksum"], "left_anti")

    def run(self, process: Callable[[list[str]], DataFrame]) -> list[int]:
        """One run; returns its batches, none if nothing is pending.

        process gets paths and returns the rows to write, with a column path that has the
        ``_metadata.file_path`` of the file a row comes from.
        """
        todo, last, done = cut(self.pending()), "", []
        while page := todo.where(F.col("path") > last).orderBy("path").limit(self.page).collect():
            last = page[-1].path
            rows = process([r.path for r in page])
            self.log.write("output", rows.withColumn("path", plain_path(F.col("path"))))
            self.log.write("manifest", self.spark.createDataFrame(page, "path string, size bigint, checksum string"))
            done.append(self.log.commit())
        return done

    def committed(self, schema: str) -> DataFrame:
        """The rows (of a schema without path) that stand: those that the last committed batch with their file brought."""
        rows = self.log.read("output", schema + ", path string")
        latest = self.manifest().select("path", F.col("latest").alias("batch"))
        return rows.join(latest, ["path", "batch"], "left_semi").drop("batch")
