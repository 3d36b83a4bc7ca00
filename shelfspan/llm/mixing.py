"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: A source's rows are cut into this many ranges of the hash key; none is ordered as a whole.
RANGE_DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Weights repeat over the sources by code point, null last.  Targets share ``share`` times
    all sizes by weight; a target above ``most`` times its source stops there and the excess
    is shared again.  That fixed point is found directly: sources in order of size over
    weight, the first ones full, the rest at one level.
    """
    cyclic = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    full = F.col("source_size") * F.lit(float(most))
    ranked = sizes.withColumn("weight", cyclic).withColumn("_full", full)
    order = Window.orderBy(F.col("_full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = ranked.withColumn("_level", level).withColumn("_over", F.col("_level") * F.col("weight") > F.col("_full"))
    first_free = F.max(F.when(~F.col("_over"), F.col("_level"))).over(Window.partitionBy())
    return filled.select(
        "source", "source_size",
        F.when(F.col("_over"), F.col("_full")).otherwise(F.least(F.col("_full"), first_free * F.col("weight"))).alias("target"),
    )


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                size: Column | None = None) -> DataFrame:
    """One row per document with the words that the mix takes of it.

    Adds ``size``, ``source_size``, ``target``, ``taken`` to the columns ``doc_id`` and
    ``source``.  Documents of a source are ordered by a hash of ``doc_id`` (null ids come as
    one key); whole epochs are taken first and the rest is cut at the exact word, so a
    source's taken words are its target rounded down.  Texts without words have size and
    taken 0; a null source is a source; an empty table gives an empty result.  Repeated rows
    each count.  Other columns are ignored.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if size is None else size
    sized = documents.select(
        "doc_id", "source", size.cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_key"),
    ).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    ranges = sized.groupBy("source", "_range").agg(F.sum("size").alias("_in_range"))
    wanted = targets(ranges.groupBy("source").agg(F.sum("_in_range").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_in_range").over(earlier), F.lit(0))).drop("_in_range")
    offsets = offsets.alias("o").join(wanted.alias("w"), F.expr("o.source <=> w.source")).select(
        F.col("o.source").alias("_source"), F.col("_range").alias("_of"), "_offset", "source_size", "target")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, (F.col("_range") == F.col("_of")) & F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("_offset") - F.col("_inside")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"),
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
            source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighed),
wanted AS (SELECT source, source_size, CASE WHEN level * weight > cap THEN cap
            ELSE least(cap, weight * (SELECT max(level) FROM levels WHERE NOT level * weight > cap)) END::DOUBLE AS target FROM levels),
placed AS (SELECT s.doc_id, s.source, s.size, w.source_size, w.target, CAST(floor(w.target) AS BIGINT) AS budget,
            CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
            FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""
