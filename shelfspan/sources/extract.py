"""Reading an extract: every cell as text, headers trimmed, blank rows dropped, keys attached."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.functions import keys as K
from shelfspan.functions import values as V
from shelfspan.operators.identity import repair_store_ids
from shelfspan.sources.contract import TABLES
from shelfspan.sources.quoted import cells, records


@dataclass
class Extract:
    raw: dict[str, DataFrame] = field(default_factory=dict)
    canon: dict[str, DataFrame] = field(default_factory=dict)
    headers: dict[str, list[str]] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)


def _read_header(spark: SparkSession, path: str) -> list[str] | None:
    try:
        first = spark.read.text(path).head(1)
    except AnalysisException:
        return None
    return next(csv.reader([first[0].value.lstrip("﻿")])) if first else []


def _distinct_names(header: list[str]) -> list[str]:
    """Trimmed names; a name already taken (in any case) gets its position appended."""
    taken, names = set(), []
    for i, name in enumerate(h.strip() for h in header):
        name = f"{name}_{i}" if name.lower() in taken else name
        taken.add(name.lower())
        names.append(name)
    return names


def read_table(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Every cell as text, rows without any dropped; files split into ranges as they are long."""
    rows = cells(records(spark, path), _distinct_names(header))
    filled = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns]
    return rows.filter(F.coalesce(*filled).isNotNull())


def read_extract(spark: SparkSession, root: str, contract: dict | None = None) -> Extract:
    """All configured tables under ``root``; an absent file is listed, not raised."""
    extract = Extract()
    contract = contract or TABLES
    for name, spec in contract.items():
        header = _read_header(spark, f"{root}/{spec['file']}")
        if header is None:
            extract.missing.append(name)
            continue
        extract.headers[name] = header
        extract.raw[name] = read_table(spark, f"{root}/{spec['file']}", header)
    master = None
    if "store_dim" in extract.raw:
        column = contract["store_dim"]["keys"]["store"]
        master = extract.raw["store_dim"].select(K.store_code(F.col(column)).alias("store_id")).distinct()
    for name, frame in extract.raw.items():
        extract.canon[name] = attach_keys(frame, contract[name], None if name == "store_dim" else master)
    return extract


def attach_keys(frame: DataFrame, spec: dict, master: DataFrame | None) -> DataFrame:
    """Canonical ids and dates as the table's contract declares them."""
    keys, out = spec.get("keys", {}), {}
    col = lambda c: F.col(f"`{c}`")
    if "store" in keys and master is not None:
        mapping = repair_store_ids(frame, keys["store"], master)
        frame = frame.join(
            mapping.withColumnRenamed("repaired", "store_id_repaired"), col(keys["store"]).eqNullSafe(F.col("raw_id")), "left"
        ).drop("raw_id")
    elif "store" in keys:
        out |= {"store_id": K.store_code(col(keys["store"])), "store_id_repaired": F.lit(False)}
    if "dns_item" in keys:
        source, colour, size = keys["dns_item"]
        dns, item = K.split_dns_item(col(source))
        out |= {"sku_uid": K.sku_uid(dns, item, col(colour), col(size)), "option_uid": K.option_uid(dns, item, col(colour))}
    if "branded" in keys:
        source, size = keys["branded"]
        parts = K.branded_key(col(source))
        out |= {
            "sku_parse_ok": parts["ok"], "brand_from_key": parts["brand"], "option_uid": parts["option_uid"],
            "sku_uid": K.sku_uid(parts["dns"], parts["item"], parts["colour"], col(size)),
        }
    if "atoms" in keys:
        dns, item, colour, size = [col(c) for c in keys["atoms"]]
        out |= {"sku_uid": K.sku_uid(dns, item, colour, size), "option_uid": K.option_uid(dns, item, colour)}
    if "city" in keys:
        out["city_norm"] = K.city(col(keys["city"]))
    if "zone" in keys:
        out["zone_norm"] = K.zone(col(keys["zone"]))
    if "brand" in keys:
        out["brand_norm"] = K.text(col(keys["brand"]))
    if "month" in keys:
        year, month = [V.number(col(c)).cast("int").cast("string") for c in keys["month"]]
        out["date"] = F.try_to_date(F.concat_ws("-", year, month, F.lit("1")), "y-M-d")
    parsed = {name: V.parse_date(col(source)) for name, source in spec.get("dates", {}).items()}
    frame = frame.withColumns(out | parsed)
    return lead_columns(frame) if "order_date" in parsed else frame


def lead_columns(frame: DataFrame) -> DataFrame:
    """Days from order to receipt; lateness too where a promise is recorded."""
    if "promised_date" not in frame.columns:
        return frame.withColumn("lead_days", F.datediff("date", "order_date"))
    late = F.datediff("date", "promised_date")
    return frame.withColumns({
        "lead_days_actual": F.datediff("date", "order_date"),
        "lead_days_promised": F.datediff("promised_date", "order_date"),
        "days_late": late,
        "on_time": F.coalesce(late <= 0, F.lit(False)),
    })


def provenance(tables: dict[str, DataFrame], missing: list[str], spark: SparkSession) -> DataFrame:
    """Every configured table: present or not, and its rows."""
    parts = [t.agg(F.lit(n).alias("table"), F.lit(True).alias("present"), F.count("*").alias("n_rows"))
             for n, t in tables.items()]
    if missing:
        parts.append(spark.createDataFrame([(n, False, 0) for n in missing], "table string, present boolean, n_rows bigint"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
