"""Queries of the operators over texts and terms, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import leakage, levels, packing, terms
from wayloom.model import current_rows, read


def _records(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for obj, table in (("node", "nodes"), ("way", "ways")):
        one = current_rows(read(spark, d, table), ["tags", "visible"]).where("visible")
        one = one.select(F.lit(obj).alias("grp"), terms.tag_terms(F.col("tags")).alias("sequences"))
        out = one if out is None else out.unionByName(one)
    return out


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    marked = terms.mark_terms(_records(spark, d), 2, 0.05)
    return marked.select(
        F.col("grp").alias("obj"), F.get("gram", 0).alias("tag_key"), F.get("gram", 1).alias("term"), "occurrences", "records", "mark"
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).where("mark IS NOT NULL").select("obj", "tag_key", "term", "mark")


def p4_grams(spark: SparkSession, d: str) -> DataFrame:
    """All n-grams of up to three words of keys and terms, from every truncated suffix; a term's words follow its key."""
    words = lambda s: F.filter(F.split(F.array_join(s, " "), " "), lambda w: w != "")
    records = _records(spark, d).withColumn("sequences", F.transform("sequences", words))
    return terms.count_grams(records, 3).select(F.col("grp").alias("obj"), F.array_join("gram", " ").alias("gram"), "occurrences", "records")


def p8_pack_512(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), 512)


def p8_pack_2048(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), 2048)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return levels.rate(read(spark, d, "documents"), read(spark, d, "level_samples"))


def _current(table: str) -> str:
    return (
        "(SELECT id, tags FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, sequence DESC) AS rn "
        f"FROM {table}) WHERE rn = 1 AND visible)"
    )


_ENTRIES = " UNION ALL ".join(
    f"SELECT '{o}' AS obj, id, unnest(map_entries(tags)) AS e FROM {_current(t)}" for o, t in (("node", "nodes"), ("way", "ways"))
)
_P4 = f"""
WITH parts AS (SELECT obj, id, lower(trim(e.key, ' ')) AS tag_key, unnest(string_split(e.value, ';')) AS p FROM ({_ENTRIES}) WHERE e.value IS NOT NULL),
terms AS (SELECT obj, id, tag_key, lower(trim(p, ' ')) AS term FROM parts WHERE trim(p, ' ') <> ''),
totals AS (SELECT obj, count(DISTINCT id) AS total FROM terms GROUP BY obj),
counts AS (SELECT obj, tag_key, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM terms GROUP BY ALL),
marked AS (SELECT c.*, unnest(CASE WHEN records <= 2 AND records * 20 >= total THEN ['rare', 'common'] WHEN records <= 2 THEN ['rare']
  WHEN records * 20 >= total THEN ['common'] ELSE [NULL] END) AS mark FROM counts c JOIN totals USING (obj))"""

QUERIES = {
    "p4_found": p4_found, "p4_terms": p4_terms, "p4_grams": p4_grams, "p8_pack_512": p8_pack_512, "p8_pack_2048": p8_pack_2048,
    "p9_found": p9_found, "p10_found": p10_found,
}
_P4_GRAMS = f"""
WITH parts AS (SELECT obj, id, lower(trim(e.key, ' ')) AS tag_key, unnest(string_split(e.value, ';')) AS p FROM ({_ENTRIES}) WHERE e.value IS NOT NULL),
seqs AS (SELECT obj, id, [w FOR w IN string_split(tag_key || ' ' || lower(trim(p, ' ')), ' ') IF w <> ''] AS ws FROM parts WHERE trim(p, ' ') <> ''),
starts AS (SELECT obj, id, ws, unnest(range(1, len(ws) + 1)) AS i FROM seqs),
grams AS (SELECT obj, id, ws[i : i + k - 1] AS g FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws))
SELECT obj, array_to_string(g, ' ') AS gram, count(*) AS occurrences, count(DISTINCT id) AS records FROM grams GROUP BY obj, g"""
ORACLES = {
    "p4_grams": _P4_GRAMS,
    "p4_found": f"{_P4} SELECT obj, tag_key, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_terms": f"{_P4} SELECT obj, tag_key, term, occurrences, records, mark FROM marked",
}
