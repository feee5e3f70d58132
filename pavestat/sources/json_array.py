"""Elements of one JSON array of large files, read by many tasks.

Spark's text source cuts files into byte ranges and rows at any separator; here at ``}``. So an
object that is an element ends where a row ends, and the question is at which. That depends on
how many quotes and brackets stand before, which is a running sum: sums per byte range come
first (a row each), then running sums inside each range begin where the ranges before ended.
Rows up to the end of an element are put together again; no task needs a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import written

#: Any text up to a bracket ``{``, strings whole.
_BEFORE = r'(?:[^{"]|"(?:[^"\\]|\\.)*")*?'
_RANGE = ["file", "block"]


def _running(df: DataFrame, value: Column, as_: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of its file that stand before."""
    own = df.withColumn("__v", value)
    inside = Window.partitionBy(*_RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = own.groupBy(*_RANGE).agg(F.sum("__v").alias("__s")).select(*_RANGE, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    return own.join(starts, _RANGE).withColumn(as_, F.col("__start") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).drop("__v", "__start")


def _count(c: Column, of: str) -> Column:
    return F.length(c) - F.length(F.translate(c, of, ""))


def elements(spark: SparkSession, path: str, name: str = "samples") -> DataFrame:
    """``(file, position, element)``: the objects of the array ``name`` of the root object, or of
    the root array, of each file below ``path``, as JSON text, ``position`` from 0. Elements
    that are no objects are left out, as are files without the array. Backslashes stand
    only in strings, as JSON has it; what follows the end of a broken file's text is not told."""
    rows = spark.read.option("lineSep", "}").text(path)
    meta = F.col("_metadata")
    rows = written(rows.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value"), "fragments")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    told = _running(rows.withColumn("quotes", quotes), F.col("quotes"), "before")
    # the row's text outside strings, whether it begins inside one or not
    inside = F.col("before") % 2 == 1
    outside = F.regexp_replace(F.when(inside, F.regexp_replace(plain, r'(?s)^[^"]*("|\z)', "")).otherwise(plain), r'(?s)"[^"]*("|\z)', "")
    closed = (F.col("before") + F.col("quotes")) % 2 == 0  # the separator itself is outside a string
    told = told.select(*_RANGE, "at", outside.alias("outside"), closed.alias("closed"), (F.col("at") == F.min("at").over(Window.partitionBy(*_RANGE))).alias("first"))
    deltas = _count(F.col("outside"), "{[") - _count(F.col("outside"), "}]") - F.col("closed").cast("int")
    told = _running(told.withColumn("delta", deltas), F.col("delta"), "depth")
    # of a root array elements end at depth 1, of an array in the root object at depth 2
    kinds = rows.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("v"))
    told = told.join(kinds.select("file", F.when(F.ltrim("v").startswith("["), 1).otherwise(2).alias("base")), "file")
    ends = F.col("closed") & (F.col("depth") + F.col("delta") == F.col("base"))
    # a row that begins outside the array, or leaves it, begins another run of elements
    leaves = (F.col("depth") < F.col("base")) | ((F.col("depth") == F.col("base")) & F.col("outside").rlike(r"^[^\[\]{]*\]"))
    told = told.select(*_RANGE, "at", "base", ends.cast("int").alias("ends"), leaves.cast("int").alias("leaves"))
    told = _running(_running(told, F.col("ends"), "number"), F.col("leaves"), "runs").withColumn("run", F.col("runs") + F.col("leaves"))
    marks = written(told.select("file", "at", "base", "number", "run", "leaves", "ends"), "marks")
    named = F.when(F.col("base") == 1, F.col("value").rlike(rf"(?s)^{_BEFORE}\{{")).otherwise(F.col("value").rlike(rf'(?s)^\s*\{{?{_BEFORE}"{name}"\s*:\s*\[\s*\{{'))
    both = marks.join(rows.select("at", "value"), "at")
    own = both.where("leaves = 1").where(named).select("file", "run", F.col("number").alias("start"))
    held = both.join(own, ["file", "run"]).groupBy("file", "run", "number", "start").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"), F.max("ends").alias("ends"), F.first("base").alias("base"))
    text = F.concat(F.array_join("parts.value", "}"), F.lit("}"))
    opening = F.when(F.col("base") == 1, F.regexp_replace(text, r"(?s)^[^{]*", "")).otherwise(F.regexp_replace(text, rf'(?s)^\s*\{{?{_BEFORE}"{name}"\s*:\s*\[\s*(?=\{{)', ""))
    element = F.when(F.col("number") == F.col("start"), opening).otherwise(F.regexp_replace(text, r"(?s)^[^{]*", ""))
    return held.where("ends = 1").select("file", (F.col("number") - F.col("start")).cast("int").alias("position"), element.alias("element"))
