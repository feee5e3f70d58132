"""Tag sheets as CSV: a row of group headings, a row of column names, then a row per image with
summaries of each dimension and a 0/1 column per tag."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of summaries (from the third), and the first column of a tag.
SUMMARIES, TAGS_FROM = range(2, 8), 8


def _said(c: Column) -> Column:
    """Text of a cell; null for an empty one."""
    text = F.trim(c.cast("string"))
    return F.when(text != "", text)


def _names(spark: SparkSession, path: str) -> list[str]:
    lines = [r[0] for r in spark.read.text(path).head(2)]
    return next(iter(csv.reader(lines[1:])), []) if len(lines) > 1 else []


def _wide(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """All rows but the second heading, columns by place."""
    schema = ", ".join(f"c{k} string" for k in range(max(len(names), TAGS_FROM)))
    rows = spark.read.schema(schema).option("multiLine", False).csv(path)
    heading = F.coalesce(F.col("c1") == F.lit(names[1] if len(names) > 1 else None), F.lit(False)) & F.col("c0").eqNullSafe(F.lit(names[0] or None if names else None))
    return rows.where(~heading)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """``(row_index, file_name, summary, labels)`` of a sheet: the summaries that are there by
    dimension, and the names of the tags whose cell is neither empty nor 0, in the order of
    columns. Rows without a file name, headings and the row of totals are left out. The file is
    cut into byte ranges; only its two headings reach the driver."""
    names = _names(spark, path)
    rows, total = _wide(spark, path, names), _total()
    dims = [(names[k], f"c{k}") for k in SUMMARIES if k < len(names)]
    pairs = F.filter(F.array(*[F.struct(F.lit(d).alias("k"), _said(F.col(c)).alias("v")) for d, c in dims]) if dims else F.array().cast("array<struct<k: string, v: string>>"), lambda p: p["v"].isNotNull())
    on = [F.when(_said(F.col(f"c{k}")).isNotNull() & (_said(F.col(f"c{k}")) != "0"), F.lit(names[k])) for k in range(TAGS_FROM, len(names))]
    labels = F.array_compact(F.array(*on)) if on else F.array().cast("array<string>")
    kept = rows.where(_said(F.col("c1")).isNotNull() & ~total)
    return kept.select(_said(F.col("c0")).try_cast("long").alias("row_index"), _said(F.col("c1")).alias("file_name"), F.map_from_entries(pairs).alias("summary"), labels.alias("labels"))


def _total() -> Column:
    return F.coalesce(_said(F.col("c0")).isNull() & F.upper(_said(F.col("c1"))).startswith("TOTAL"), F.lit(False))


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``(tag, stated, counted)``: what the sheet's row of totals says of each tag, and in how
    many rows it stands: they are equal where the labels say the same as the sheet. ``stated``
    is null without such a row."""
    names = _names(spark, path)
    own = [(names[k], f"c{k}") for k in range(TAGS_FROM, len(names))]
    cells = [F.struct(F.lit(t).alias("tag"), _said(F.col(c)).try_cast("double").cast("long").alias("stated")) for t, c in own]
    if not cells:
        return spark.createDataFrame([], "tag string, stated long, counted long")
    stated = _wide(spark, path, names).where(_total()).select(F.inline(F.array(*cells))).groupBy("tag").agg(F.max("stated").alias("stated"))
    counted = sheet(spark, path).select(F.explode("labels").alias("tag")).groupBy("tag").agg(F.count("*").alias("counted"))
    listed = spark.createDataFrame([(t,) for t, _ in own], "tag string")
    return listed.join(stated, "tag", "left").join(counted, "tag", "left").select("tag", "stated", F.coalesce("counted", F.lit(0)).cast("long").alias("counted"))
