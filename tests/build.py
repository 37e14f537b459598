"""Small tables from short texts, and their comparison."""

from __future__ import annotations

from wayloom.model import NODES, RELATIONS, WAYS, Source


def nodes(spark, *rows):
    """(id, x, y[, tags])"""
    return spark.createDataFrame([(r[0], r[3] if len(r) > 3 else {}, float(r[1]), float(r[2])) for r in rows], NODES)


def grid(spark, *ids):
    """Nodes a ten-thousandth of a degree apart in x, in the order of their ids."""
    return nodes(spark, *((i, 1 + i * 0.0001, 1.0) for i in ids))


def ways(spark, spec):
    """{id: nodes or (nodes, tags)}"""
    rows = [(i, v[1] if isinstance(v, tuple) else {}, list(v[0] if isinstance(v, tuple) else v)) for i, v in spec.items()]
    return spark.createDataFrame(rows, WAYS)


def relations(spark, spec):
    """{id: "w1 r2@role ..." or (members, tags)}"""
    rows = []
    for i, v in spec.items():
        text, tags = v if isinstance(v, tuple) else (v, {})
        members = []
        for m in text.split():
            ref, _, role = m.partition("@")
            members.append((int(ref[1:]), role, ref[0].upper()))
        rows.append((i, tags, members))
    return spark.createDataFrame(rows, RELATIONS)


def changes(spark, *codes):
    """"M1", "D2", ..."""
    return spark.createDataFrame([(int(c[1:]), c[0]) for c in codes], "id bigint, action string")


def source(data, spark=None, *codes):
    return Source(data, changes(spark, *codes) if spark is not None else None)


def rows(df, *columns):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())


def codes(df):
    return sorted(f"{r.action}{r.id}" for r in df.collect())


def fixed(df):
    """The rows as they are now, without the plan that made them."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
