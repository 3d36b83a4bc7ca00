"""The retail tables of the contract, derived from a star schema with an event stream.

A user is a store that carries two of a hundred and two SKUs; which two follows from its
number, and the parity of an event id picks one of them.  A ``signup`` event is a delivery
of four units and every other event is one unit of demand.  The walk is the
usual reflected random walk: demand that meets an empty shelf is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan.operators.panel import PAIR, infer_receipts
from shelfspan.operators.spells import build_spells
from shelfspan.session import cut_lineage

UNITS_PER_DELIVERY = 4
PROMISED_DAYS = 45
#: Assortments: stores whose numbers are equal modulo this carry the same two SKUs.
ASSORTMENTS = 51


def store_key(user: Column) -> Column:
    return F.concat(F.lit("ST"), user.cast("string"))


def sku_key(part: Column) -> Column:
    return F.concat(F.lit("SKU"), part.cast("string"))


def part_of(which: Column, user: Column) -> Column:
    """The number of a store's first (0) or second (1) SKU."""
    return which * ASSORTMENTS + user % ASSORTMENTS


def warehouse_key(region: Column) -> Column:
    return F.concat(F.lit("WH_"), region)


@dataclass
class EventFeed:
    """Lazy tables over one data directory; nothing runs until an action does."""

    spark: SparkSession
    root: str
    single_delivery: bool = False

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def flow(self) -> DataFrame:
        """Deliveries and demand per store x SKU x day, dense over the common window.

        Events are combined on the map side before the first shuffle, so a user holding a
        third of the stream arrives as one row per SKU and day.
        """
        events = self.raw("events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("date"))
        is_delivery = F.col("event_type") == "signup"
        daily = events.groupBy(
            "user_id", part_of(F.col("event_id") % 2, F.col("user_id")).alias("part"), "date"
        ).agg(
            (F.count_if(is_delivery) * UNITS_PER_DELIVERY).alias("rcv"),
            F.count_if(~is_delivery).alias("dem"),
        )
        window = events.agg(F.min("date").alias("first"), F.max("date").alias("last"))
        days = F.sequence(
            window.select("first").scalar(), window.select("last").scalar(), F.expr("interval 1 day")
        )
        spine = (
            events.select("user_id").distinct()
            .select("user_id", F.explode(F.array(*[part_of(F.lit(i).cast("bigint"), F.col("user_id")) for i in (0, 1)])).alias("part"))
            .select("user_id", "part", F.explode(days).alias("date"), F.lit(0).alias("rcv"), F.lit(0).alias("dem"))
        )
        dense = (
            daily.unionByName(spine)
            .select(store_key(F.col("user_id")).alias("store_id"), sku_key(F.col("part")).alias("sku_uid"),
                    "user_id", "part", "date", "rcv", "dem")
            .repartition(*PAIR)
            .groupBy(*PAIR, "user_id", "part", "date")
            .agg(F.sum("rcv").alias("rcv"), F.sum("dem").alias("dem"))
        )
        if self.single_delivery:
            first = F.min(F.when(F.col("rcv") > 0, F.col("date"))).over(Window.partitionBy(*PAIR))
            dense = dense.withColumn("rcv", F.when(F.col("date") == first, F.col("rcv")).otherwise(0))
        return dense

    @cached_property
    def walk(self) -> DataFrame:
        by_day = Window.partitionBy(*PAIR).orderBy("date")
        upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        free = F.sum(F.col("rcv") - F.col("dem")).over(upto)
        return (
            self.flow.withColumn("free", free)
            .withColumn("floor", F.min("free").over(upto))
            .withColumn("stock", F.col("free") - F.least(F.lit(0), F.col("floor")))
            .withColumn("opened", F.coalesce(F.lag("stock").over(by_day), F.lit(0)))
            .withColumn("sold", F.least(F.col("dem"), F.col("opened") + F.col("rcv")))
            .withColumn("lost", F.col("dem") - F.col("sold"))
            .withColumn("inbound", F.coalesce(F.lead("rcv").over(by_day), F.lit(0)))
        )

    def settled(self) -> EventFeed:
        """This feed with its walk written once, for queries that read several tables made of it."""
        if "_settled" not in self.__dict__:
            walk = self.walk.select(*PAIR, "user_id", "part", "date", "rcv", "dem", "stock", "sold", "lost", "inbound")
            # tables made of the unwritten walk are made again
            for made in ("inventory_daily", "shelf", "ledger", "ledger_with_inbound", "spells", "sales_pos"):
                self.__dict__.pop(made, None)
            self.__dict__.update(walk=cut_lineage(walk), _settled=True)
        return self

    # -- dimensions ---------------------------------------------------------
    @cached_property
    def store_dim(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                store_key(F.col("c_custkey")).alias("store_id"),
                F.col("n_name").alias("city_norm"),
                F.col("r_name").alias("zone_norm"),
                F.col("n_regionkey").alias("region_key"),
                F.concat(F.lit("Tier "), (F.col("c_custkey") % 4 + 1).cast("string")).alias("TIER"),
                F.col("c_mktsegment").alias("segment"),
                warehouse_key(F.col("r_name")).alias("dc_id"),
            )
        )

    @cached_property
    def product_dim(self) -> DataFrame:
        return self.raw("part").select(
            sku_key(F.col("p_partkey")).alias("sku_uid"),
            F.col("p_brand").alias("option_uid"),
            F.col("p_size").cast("string").alias("size"),
            F.col("p_type").alias("CATEGORY"),
            F.col("p_retailprice").alias("price"),
        )

    # -- facts --------------------------------------------------------------
    @cached_property
    def inventory_daily(self) -> DataFrame:
        region = self.store_dim.select("store_id", "region_key")
        return (
            self.walk.join(region, "store_id", "left")
            .withColumn("warehouse_stock",
                        (100 + 37 * F.col("region_key") + 11 * F.col("part") + 3 * F.dayofmonth("date")).cast("double"))
            .select(*PAIR, "date", F.col("stock").cast("double").alias("store_stock"), "warehouse_stock",
                    F.col("inbound").cast("double").alias("intransit_stock"))
            .withColumn("opening_stk", F.col("warehouse_stock") + F.col("store_stock") + F.col("intransit_stock"))
        )

    @cached_property
    def shelf(self) -> DataFrame:
        """Inventory without the DC columns: no dimension join."""
        return self.walk.select(*PAIR, "date", F.col("stock").cast("double").alias("store_stock"))

    @cached_property
    def ledger(self) -> DataFrame:
        """Stock, sales, lost demand and inferred receipts without re-joining the facts."""
        return infer_receipts(self.walk.select(
            *PAIR, "date", F.col("stock").cast("double").alias("store_stock"),
            F.col("sold").cast("double").alias("units_sold"), F.col("lost").cast("double").alias("lost_units"),
        ))

    @cached_property
    def ledger_with_inbound(self) -> DataFrame:
        return infer_receipts(self.walk.select(
            *PAIR, "date", F.col("stock").cast("double").alias("store_stock"),
            F.col("sold").cast("double").alias("units_sold"), F.col("inbound").cast("double").alias("intransit_stock"),
        ))

    @cached_property
    def spells(self) -> DataFrame:
        return build_spells(self.ledger)

    @cached_property
    def sales_pos(self) -> DataFrame:
        return self.walk.filter("sold > 0").select(*PAIR, "date", F.col("sold").cast("double").alias("units_sold"))

    @cached_property
    def replenishment_orders(self) -> DataFrame:
        return (
            self.raw("events").filter("event_type = 'signup'")
            .select(
                store_key(F.col("user_id")).alias("store_id"),
                sku_key(part_of(F.col("event_id") % 2, F.col("user_id"))).alias("sku_uid"),
                F.date_sub(F.col("ts").cast("date"), (1 + F.col("event_id") % 5).cast("int")).alias("date"),
                F.lit(float(UNITS_PER_DELIVERY)).alias("qty"),
            )
        )

    @cached_property
    def goods_receipts(self) -> DataFrame:
        """Vendor deliveries: every line of an order with its promise."""
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                           F.col("o_orderdate").cast("date").alias("order_date"))
        supplier = self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("Vendor_Name"))
        return (
            self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate")
            .join(orders, "l_orderkey").join(supplier, "l_suppkey")
            .select(
                "Vendor_Name", sku_key(F.col("l_partkey")).alias("sku_uid"),
                F.col("l_quantity").alias("Qty_Received"),
                F.col("l_shipdate").cast("date").alias("date"), "order_date",
                F.date_add("order_date", PROMISED_DAYS).alias("promised_date"),
            )
        )

    @cached_property
    def pending_orders(self) -> DataFrame:
        orders = self.raw("orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
        return (
            self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
            .join(orders, "l_orderkey", "left_semi")
            .select(sku_key(F.col("l_partkey")).alias("sku_uid"),
                    F.concat(F.lit("V"), F.col("l_suppkey").cast("string")).alias("vendor_id"),
                    F.col("l_quantity").alias("quantity"))
        )

    @cached_property
    def forecast(self) -> DataFrame:
        """Monthly plan per option and size; January 2024 only, as the stream is."""
        return self.raw("part").select(
            F.col("p_brand").alias("option_uid"), F.col("p_size").cast("string").alias("size"),
            F.lit(2024).alias("year"), F.lit(1).alias("month"),
            ((F.col("p_partkey") % 7 + 1) * 30).cast("double").alias("prediction_size"),
            F.col("p_retailprice").alias("avg_price"),
            (45 + F.col("p_partkey") % 46).cast("double").alias("lead_time"),
        )

    @cached_property
    def promotion_data(self) -> DataFrame:
        window = self.raw("events").agg(F.min("ts").cast("date").alias("first"), F.max("ts").cast("date").alias("last"))
        days = F.sequence(
            window.select("first").scalar(), window.select("last").scalar(), F.expr("interval 1 day")
        )
        return (
            self.raw("nation").select("n_name", "n_nationkey", F.explode(days).alias("date"))
            .select(
                F.col("n_name").alias("city_norm"), "date",
                ((F.dayofmonth("date") + F.col("n_nationkey")) % 7 == 0).cast("int").alias("promotion_flag"),
                ((F.dayofmonth("date") * 3 + F.col("n_nationkey")) % 11 == 0).cast("int").alias("holiday_flag"),
            )
        )

    @cached_property
    def forecast_store_week(self) -> DataFrame:
        """Weekly units by the supplier's nation; the plan is the week before."""
        supplier = self.raw("supplier").select("s_suppkey", "s_nationkey")
        weekly = (
            self.raw("lineitem").select("l_suppkey", "l_quantity", "l_shipdate")
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("s_nationkey", F.to_date(F.date_trunc("week", F.col("l_shipdate").cast("timestamp"))).alias("date"))
            .agg(F.sum("l_quantity").alias("actual_units"))
        )
        before = F.lag("actual_units").over(Window.partitionBy("s_nationkey").orderBy("date"))
        return weekly.select(
            store_key(F.col("s_nationkey")).alias("store_id"), "date",
            F.coalesce(before, F.lit(0.0)).alias("forecast_units"), "actual_units",
        )
