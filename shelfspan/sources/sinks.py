"""Exports: rows are written aside, then become the current version in one step.

Executors write to a folder no reader knows.  What was written is counted and described in
a manifest, and the manifest takes the place of the old one by a single rename.  A reader
sees the version before or the version after, whatever fails in between, and running an
export again only writes another folder and renames once more.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
RISK_COLUMNS = [
    "as_of", "store_id", "sku_uid", "category", "size_label", "risk_band", "risk_score", "stock_on_hand", "cover_days_now", "trailing_demand_rate",
    "p_stockout_7d", "p_stockout_14d", "p_stockout_28d", "expected_days_out", "expected_lost_units", "expected_lost_revenue",
    "rank_by_risk", "rank_by_units", "rank_by_revenue",
]
PRESCRIPTION_COLUMNS = [
    "store_id", "sku_uid", "recommended_action", "rebalance_donor", "expected_units_saved", "expected_net_value",
    "expected_margin_protected", "baseline_expected_lost_units", "stock_on_hand", "trailing_demand_rate",
]


def pick(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return frame.select(*[c for c in columns if c in frame.columns])


def with_policy_provenance(policy: DataFrame, estimator: str, validated: bool, service_level: float) -> DataFrame:
    """Reorder points travel with the name and standing of the estimator behind them."""
    return policy.withColumns({
        "estimator": F.lit(estimator), "validated": F.lit(validated), "service_level": F.lit(service_level),
    })


def prescriptions(recommendations: DataFrame) -> DataFrame:
    """Today's shelf is in ``start_stock``; it never leaves under that name."""
    return pick(recommendations.withColumnRenamed("start_stock", "stock_on_hand"), PRESCRIPTION_COLUMNS)


def risk_list(scored: DataFrame) -> DataFrame:
    return pick(scored, RISK_COLUMNS)


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, text: str, path) -> None:
    """The whole file at ``path`` becomes ``text`` at once."""
    fresh = _path(spark, path.getParent().toString(), f"_{path.getName()}-{uuid.uuid4().hex}")
    out = _files(spark, fresh).create(fresh, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, path, how)


def manifest(spark: SparkSession, folder: str, name: str) -> dict | None:
    """What the current version of an export holds, None where nothing is published."""
    path = _path(spark, folder, name, MANIFEST)
    if not _files(spark, path).exists(path):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(path.toString()).collect()))


def publish(frame: DataFrame, folder: str, name: str, about: dict | None = None, keep: int = 2) -> dict:
    """Write ``frame`` under ``folder/name`` and make it the current version; returns its manifest.

    ``about`` is carried in the manifest.  The last ``keep`` versions stay on disk for
    readers that have begun on them.
    """
    spark = frame.sparkSession
    version = uuid.uuid4().hex
    rows = f"versions/{version}"
    before = manifest(spark, folder, name)
    frame.write.parquet(f"{folder}/{name}/{rows}")
    written = spark.read.parquet(f"{folder}/{name}/{rows}")
    told = {
        "name": name, "version": version, "rows_in": rows, "n_rows": written.count(), "schema": json.loads(written.schema.json()), "about": about or {},
        "earlier": [rows_in for rows_in in [before["rows_in"], *before["earlier"]]] if before else [],
    }
    told["earlier"], old = told["earlier"][: keep - 1], told["earlier"][keep - 1 :]
    _replace(spark, json.dumps(told), _path(spark, folder, name, MANIFEST))
    for rows_in in old:
        path = _path(spark, folder, name, rows_in)
        _files(spark, path).delete(path, True)
    return told


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The current version of an export; rows that do not agree with its manifest are an error."""
    told = manifest(spark, folder, name)
    if told is None:
        raise FileNotFoundError(f"nothing is published as {name} in {folder}")
    rows = spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{folder}/{name}/{told['rows_in']}")
    if rows.count() != told["n_rows"]:
        raise ValueError(f"{name} holds other rows than its manifest says")
    return rows
