"""Records of quoted CSV files, read in parallel although a cell may hold line breaks.

A file is read line by line in byte ranges.  A line break ends a record only where an even
number of quotes lies before it, and how many do follows from prefix sums: quotes per
range, carried over the (few) ranges, then per line.  Ranges where no cell is open at
either end and no line opens one are not shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan.session import cut_lineage


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    return spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("line"), "value", odd.alias("odd"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` for each record behind the header of every file under ``path``.

    Line breaks inside a cell come back as ``\\n``.  The header is the first line of a file.
    A quote that is never closed makes one record of the rest of its file.
    """
    lines = _lines(spark, path)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut_lineage(
        lines.groupBy("file", "block").agg(F.sum("odd").alias("odds"), F.min("line").alias("first"))
        .withColumn("open", F.coalesce(F.sum("odds").over(earlier), F.lit(0)) % 2)
    )
    header = (F.col("block") == 0) & (F.col("line") == F.col("first"))
    placed = lines.join(blocks, ["file", "block"]).filter(~header)
    torn = (F.col("odds") > 0) | (F.col("open") > 0)
    whole = placed.filter(~torn).select(F.col("value").alias("record"))
    if blocks.filter(torn).isEmpty():
        return whole

    inside = Window.partitionBy("file", "block").orderBy("line")
    before = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = (((F.col("open") + F.col("_before")) % 2) == 0).cast("int")
    parts = placed.filter(torn).withColumn("_before", before).withColumn("begins", begins).withColumn("number", F.sum("begins").over(inside))
    begun = parts.groupBy("file", "block").agg(F.sum("begins").alias("n"))
    latest = F.last(F.when(F.col("n") > 0, F.struct("block", "n")), ignorenulls=True).over(earlier)
    owner = begun.select("file", "block", latest.alias("owner"))
    # lines before the first record of a range belong to the last one begun earlier
    own = F.struct("block", F.col("number").alias("n"))
    keyed = parts.join(owner, ["file", "block"]).withColumn("key", F.when(F.col("number") > 0, own).otherwise(F.col("owner")))
    pieces = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    joined = keyed.groupBy("file", "key").agg(F.concat_ws("\n", F.transform(pieces, lambda p: p["value"])).alias("record"))
    return whole.unionByName(joined.select("record"))


def cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """A text column per name from ``record``; quotes inside a cell are doubled."""
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    parsed = rows.select(F.from_csv("record", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("_cells"))
    return parsed.select("_cells.*")
