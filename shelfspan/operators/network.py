"""Which stores draw on one pool, and which DC the configuration assigns to a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan.functions import keys as K
from shelfspan.operators.graph import components
from shelfspan.session import cut_lineage

SINGLE_POOL_SHARE = 0.01
#: Two reports agree when they differ by no more than this and this share of the value.
ABSOLUTE, RELATIVE = 1e-8, 1e-5


def varying_share(inventory: DataFrame, value: str = "warehouse_stock") -> DataFrame:
    """Share of SKU-days on which stores report more than one DC stock."""
    spread = (
        inventory.filter(F.col(value).isNotNull() & F.col("date").isNotNull())
        .groupBy("sku_uid", "date").agg((F.min(value) != F.max(value)).cast("int").alias("varies"))
    )
    return spread.agg(F.count("*").alias("sku_days"), F.avg("varies").alias("varying_share"))


def _observations(inventory: DataFrame, value: str) -> DataFrame:
    return (
        inventory.filter(F.col(value).isNotNull() & F.col("date").isNotNull())
        .groupBy("store_id", "sku_uid", "date").agg(F.min(F.col(value).cast("double")).alias("value"))
    )


def _tolerance(value: Column) -> Column:
    return ABSOLUTE + RELATIVE * F.abs(value)


def _candidates(seen: DataFrame) -> DataFrame:
    """``node, label``: stores that may agree somewhere have the same label.

    Stores and (SKU, day, value bucket) are the two sides of a graph.  Buckets are as wide
    as the tolerance on a scale where it is constant, and a value belongs to its own and the
    next one, so values that agree always meet.  A bucket's stores are all linked to its
    smallest one: a link per report, never one per pair.
    """
    even = F.signum("value") * F.log1p(F.abs("value") * (RELATIVE / ABSOLUTE))
    bucket = F.floor(even / (1.1 * RELATIVE))
    held = seen.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    hub = F.min("store_id").over(Window.partitionBy("sku_uid", "date", "bucket"))
    edges = held.select(F.col("store_id").alias("a"), hub.alias("b")).filter("a <> b").distinct()
    return components(seen.select("store_id").distinct(), edges, "store_id")


def _agreeing_pairs(left: DataFrame, right: DataFrame, min_overlap: int) -> DataFrame:
    """Pairs of stores of one label that agree wherever both report, over enough SKU-days."""
    sides = [df.select("label", "sku_uid", "date", F.col("store_id").alias(n), F.col("value").alias(f"v{n}")) for df, n in ((left, "a"), (right, "b"))]
    apart = F.abs(F.col("va") - F.col("vb")) > _tolerance(F.when(F.col("a") < F.col("b"), F.col("vb")).otherwise(F.col("va")))
    return (
        sides[0].join(sides[1], ["label", "sku_uid", "date"]).filter("a <> b")
        .groupBy("a", "b").agg(F.count("*").alias("common"), F.max(apart.cast("int")).alias("apart"))
        .filter((F.col("common") >= min_overlap) & (F.col("apart") == 0)).select("a", "b")
    )


def store_groups(inventory: DataFrame, value: str = "warehouse_stock", min_overlap: int = 5) -> DataFrame:
    """Stores linked when they agree on every SKU-day both report, over enough of them.

    Candidates come from shared value buckets.  Where no SKU-day of a candidate group holds
    two values, all its stores agree and only the overlap counts: every store is compared
    with the one that reports most, and stores that share too little with it with the rest.
    Pairs of all stores are formed only inside groups that disagree somewhere, and there one
    store stands for all that report exactly the same.  Agreement uses the tolerance 1e-8 +
    1e-5 of the value.
    """
    seen = cut_lineage(_observations(inventory, value))
    days = seen.groupBy("store_id").agg(F.count("*").alias("days"))
    labels = _candidates(seen).select(F.col("node").alias("store_id"), "label")
    placed = cut_lineage(labels.join(days, "store_id"))
    able = placed.filter(F.col("days") >= min_overlap)
    labelled = seen.join(able.select("store_id", "label"), "store_id")
    low, high = F.min("value"), F.max("value")
    split = labelled.groupBy("label", "sku_uid", "date").agg((high - low > _tolerance(F.least(F.abs(low), F.abs(high)))).alias("split"))
    state = cut_lineage(split.groupBy("label").agg(F.max("split").alias("split")))
    clean, torn = (labelled.join(state.filter(c).select("label"), "label", "left_semi") for c in ("NOT split", "split"))

    most = able.groupBy("label").agg(F.max_by("store_id", F.struct("days", F.col("store_id"))).alias("anchor"))
    anchors = clean.join(most, "label").filter("store_id = anchor").drop("anchor")
    near = cut_lineage(_agreeing_pairs(clean, anchors, min_overlap))
    links = near
    apart = cut_lineage(clean.join(near.select(F.col("a").alias("store_id")), "store_id", "left_anti").join(most.select(F.col("anchor").alias("store_id")), "store_id", "left_anti"))
    if not apart.isEmpty():
        links = links.unionByName(_agreeing_pairs(apart, clean, min_overlap))
    if not state.filter("split").isEmpty():
        signed = _signatures(torn)
        shape = ["label", "days", "one", "two"]
        same = cut_lineage(signed.join(signed.groupBy(*shape).agg(F.min("store_id").alias("anchor")), shape).select("store_id", "anchor"))
        alone = torn.join(same.filter("store_id = anchor").select("store_id"), "store_id", "left_semi")
        links = links.unionByName(same.filter("store_id <> anchor").select(F.col("store_id").alias("a"), F.col("anchor").alias("b")))
        links = links.unionByName(_agreeing_pairs(alone, alone, min_overlap))
    return components(placed.select("store_id"), links, "store_id").select(F.col("node").alias("store_id"), F.col("label").alias("pool"))


def _signatures(seen: DataFrame) -> DataFrame:
    """One order-free fingerprint of everything a store reports."""
    row = ["sku_uid", "date", "value"]
    return seen.groupBy("label", "store_id").agg(
        F.count("*").alias("days"), F.bit_xor(F.xxhash64(*row)).alias("one"),
        F.bit_xor(F.xxhash64(F.lit("second"), *row)).alias("two"),
    )


def dc_verdict(inventory: DataFrame, groups: DataFrame) -> DataFrame:
    share = varying_share(inventory).select("varying_share")
    n = groups.agg(F.count_distinct("pool").alias("n")).scalar()
    single = F.col("varying_share") < SINGLE_POOL_SHARE
    return share.select(
        "varying_share", F.when(single, 1).otherwise(n).alias("n_groups"),
        F.when(single, "single pool").when(n > 1, "serving groups").otherwise("inconsistent").alias("verdict"),
    )


def ambiguous_zones(dcs: DataFrame) -> DataFrame:
    """Zones that two DCs claim."""
    lanes = dcs.select("dc_id", F.explode("serves_zones").alias("z")).select("dc_id", K.text(F.col("z")).alias("zone"))
    return lanes.groupBy("zone").agg(F.count_distinct("dc_id").alias("n_dcs"), F.min("dc_id").alias("first_dc"), F.max("dc_id").alias("other_dc")).filter("n_dcs > 1")


def dc_of_store(stores: DataFrame, dcs: DataFrame, zone: str = "ZONE") -> DataFrame:
    """The DC whose zones hold the store's zone; ``mapped`` is false where the first DC stands in.

    A zone claimed by two DCs is an error when the rows are read: the query fails and names it.
    """
    lanes = dcs.select("dc_id", F.explode("serves_zones").alias("_z")).select("dc_id", K.text(F.col("_z")).alias("_zone"))
    claimed = F.concat(F.lit("zone "), F.col("_zone"), F.lit(" is served by "), F.min("dc_id"), F.lit(" and "), F.max("dc_id"))
    unique = lanes.groupBy("_zone").agg(F.when(F.min("dc_id") == F.max("dc_id"), F.min("dc_id")).otherwise(F.raise_error(claimed)).alias("dc_id"))
    fallback = dcs.agg(F.min_by("dc_id", "position").alias("d")).scalar()
    joined = stores.withColumn("_zone", K.text(F.col(zone))).join(unique, "_zone", "left")
    return joined.withColumn("mapped", F.col("dc_id").isNotNull()).withColumn("dc_id", F.coalesce("dc_id", fallback)).drop("_zone")
