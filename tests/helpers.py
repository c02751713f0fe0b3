"""Small builders shared by the tests."""

from pyspark.sql import functions as F

from talkmill.schema import TABLES, empty_table


def ts(text):
    return F.lit(text).cast("timestamp")


def table(spark, name, rows):
    """A canonical table from dicts; times are given as text."""
    if not rows:
        return empty_table(spark, name)
    fields = [f.split(" ", 1) for f in TABLES[name].split(", ")]
    text = ", ".join(f"{c} {'string' if t == 'timestamp' else t}" for c, t in fields)
    df = spark.createDataFrame([tuple(r.get(c) for c, _ in fields) for r in rows], text)
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in fields])


def one(df, column):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0][column]


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
