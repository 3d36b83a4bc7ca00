import pytest
from pyspark.sql import functions as F

from shelfspan.functions import keys as K
from shelfspan.operators.identity import near_duplicates, repair_store_ids
from shelfspan.sources.extract import provenance, read_extract


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_branded_key_keeps_separators_in_the_colour(spark):
    got = one(spark, **K.branded_key(F.lit(" metro_57_38_rose_gold ")))
    assert got == {"ok": True, "brand": "METRO", "dns": "57", "item": "38", "colour": "ROSE-GOLD", "option_uid": "57_38_ROSE-GOLD"}


def test_sized_key_and_item_numbers(spark):
    assert one(spark, **K.sized_key(F.lit("900_1690_BLUE/NAVY_84")))["sku_uid"] == "900_1690_BLUE-NAVY_84"
    assert one(spark, **K.itemnumber(F.lit("35-205-XAN-37-1")))["size"] == "37"
    assert one(spark, **K.itemnumber(F.lit("35-3152-007"))) == {"ok": True, "dns": "35", "item": "3152", "colour": "", "size": ""}
    assert not one(spark, **K.sized_key(F.lit("nonsense")))["ok"]


@pytest.mark.parametrize("raw,size,scale", [("40.0", "40", "EU"), ("040", "40", "EU"), ("90", "90", "ALT"), ("XL", "XL", "UNKNOWN"), (None, "", "UNKNOWN")])
def test_sizes(spark, raw, size, scale):
    assert one(spark, s=K.size(F.lit(raw)), c=K.size_scale(F.lit(raw))) == {"s": size, "c": scale}


def test_store_repair_refuses_what_it_cannot_settle(spark):
    ids = spark.createDataFrame([("GUSO3",), ("gus 03",), ("ABO1",), ("ZZ9",)], "raw string")
    master = spark.createDataFrame([("GUS03",), ("AB01",), ("ABO1X",)], "store_id string")
    got = {r.raw_id: (r.store_id, r.repaired) for r in repair_store_ids(ids, "raw", master).collect()}
    assert got == {"GUSO3": ("GUS03", True), "gus 03": ("GUS03", False), "ABO1": ("AB01", True), "ZZ9": ("ZZ9", False)}
    both = spark.createDataFrame([("X0O",), ("XO0",)], "store_id string")
    assert not repair_store_ids(spark.createDataFrame([("XOO",)], "raw string"), "raw", both).first().repaired


def test_near_duplicates_against_brute_force(spark):
    words = ["LAMP & POST", "LAMP & PAST", "AAB", "AB", "ABC", "AC", "B", "BAAB", "LAMP & POSTS"]
    got = {(r.first_value, r.second_value) for r in near_duplicates(spark.createDataFrame([(w,) for w in words], "v string"), "v").collect()}

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_extract_keeps_text_and_lists_what_is_missing(spark, tmp_path):
    (tmp_path / "store_dim.csv").write_text("storeid,city,ZONE ,TIER\nGUS03,Guwahati,East Zone,Tier 2\n,,,\n")
    (tmp_path / "sales_pos.csv").write_text("storeid,dns_item,color,size,Date,units_sold\nGUSO3,14_1033,ROSE GOLD,40.0,########,2\nGUS03,14_1033,TAN,41,20240105,1\n")
    extract = read_extract(spark, str(tmp_path))
    assert "inventory_daily" in extract.missing and extract.headers["store_dim"][2] == "ZONE "
    assert extract.raw["store_dim"].count() == 1
    got = {r.sku_uid: (r.store_id, r.store_id_repaired, str(r.date)) for r in extract.canon["sales_pos"].collect()}
    assert got == {"14_1033_ROSE-GOLD_40": ("GUS03", True, "None"), "14_1033_TAN_41": ("GUS03", False, "2024-01-05")}
    counts = {r.table: (r.present, r.n_rows) for r in provenance(extract.canon, extract.missing, spark).collect()}
    assert counts["store_dim"] == (True, 1) and counts["forecast"] == (False, 0)


def test_quoted_cells_and_line_breaks(spark, tmp_path):
    from shelfspan.sources.extract import read_table

    path = tmp_path / "cells.csv"
    path.write_text('a,b\n"say ""hi"", now",1\n"two\nlines",2\n')
    assert sorted(map(tuple, read_table(spark, str(path), ["a", "b"]).collect())) == [('say "hi", now', "1"), ("two\nlines", "2")]
