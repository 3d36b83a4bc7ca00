"""Canonical keys, dates, store-id repair, bridges."""

from pyspark.sql import functions as F

from parity.base import cte, query
from shelfspan.functions import keys as K
from shelfspan.functions import values as V
from shelfspan.operators import identity as I
from shelfspan.sources.extract import lead_columns

cte("key_texts", """
SELECT p_partkey,
       '  ' || lower(p_type) || '_' || p_partkey || '_' || p_size || '_' || replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '_' WHEN p_partkey % 3 = 1 THEN '/' ELSE '  ' END) || ' ' AS branded,
       p_partkey || '_' || p_size || '_' || replace(p_name, ' ', '/') || '_' || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS sized,
       CASE WHEN p_partkey % 4 = 0 THEN p_partkey || '-' || p_size || '-007'
            WHEN p_partkey % 4 = 1 THEN p_partkey || '-' || p_size || '-' || left(p_name, 3) || '-0' || p_size || '-1'
            ELSE p_brand || '-' || p_size END AS itemnumber,
       CASE WHEN p_partkey % 4 = 0 THEN '0' || p_size WHEN p_partkey % 4 = 1 THEN p_size || '.00'
            WHEN p_partkey % 4 = 2 THEN CAST(p_size + 45 AS VARCHAR) ELSE p_size || 'EU' END AS size_text,
       p_name AS colour_text, p_brand, p_size
FROM part
""")


def key_texts(feed):
    part = feed.raw("part")
    key, size, name = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_name")
    glue = F.when(key % 3 == 0, "_").when(key % 3 == 1, "/").otherwise("  ")
    return part.select(
        "p_partkey",
        F.concat(F.lit("  "), F.lower("p_type"), F.lit("_"), key, F.lit("_"), size, F.lit("_"), F.replace(name, F.lit(" "), glue), F.lit(" ")).alias("branded"),
        F.concat_ws("_", key.cast("string"), size, F.replace(name, F.lit(" "), F.lit("/")), F.when(key % 5 == 0, "x").otherwise(size)).alias("sized"),
        F.when(key % 4 == 0, F.concat_ws("-", key.cast("string"), size, F.lit("007")))
        .when(key % 4 == 1, F.concat_ws("-", key.cast("string"), size, F.left(name, F.lit(3)), F.concat(F.lit("0"), size), F.lit("1")))
        .otherwise(F.concat_ws("-", "p_brand", size)).alias("itemnumber"),
        F.when(key % 4 == 0, F.concat(F.lit("0"), size)).when(key % 4 == 1, F.concat(size, F.lit(".00")))
        .when(key % 4 == 2, (F.col("p_size") + 45).cast("string")).otherwise(F.concat(size, F.lit("EU"))).alias("size_text"),
        name.alias("colour_text"), "p_brand", "p_size",
    )


def txt(c):
    return f"trim(regexp_replace(upper(coalesce({c}, '')), '\\s+', ' ', 'g'))"


def col(c):
    return f"trim(regexp_replace({txt(c)}, '[\\s/_\\-]+', '-', 'g'), '-')"


def siz(c):
    return (f"CASE WHEN regexp_full_match({txt(c)}, '\\d+(\\.0+)?') THEN CAST(CAST(CAST({txt(c)} AS DOUBLE) AS BIGINT) AS VARCHAR) "
            f"ELSE {txt(c)} END")


def grab(c, pattern, i):
    return f"regexp_extract({txt(c)}, '{pattern}', {i})"


@query("canonical_keys", "p_partkey:i style:s option_uid:s sku_uid:s colour:s size:s store:s zone:s", f"""
SELECT p_partkey, {txt('p_brand')} || '_' || p_size AS style, {txt('p_brand')} || '_' || p_size || '_' || {col('colour_text')} AS option_uid,
       {txt('p_brand')} || '_' || p_size || '_' || {col('colour_text')} || '_' || {siz('size_text')} AS sku_uid,
       {col('branded')} AS colour, {siz('size_text')} AS size, replace({txt('colour_text')}, ' ', '') AS store,
       trim(regexp_replace({txt("p_brand || ' Zone '")}, '\\s*ZONE\\s*$', '')) AS zone
FROM key_texts
""")
def _canonical(feed):
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    return key_texts(feed).select(
        "p_partkey", K.style_uid(brand, size).alias("style"), K.option_uid(brand, size, F.col("colour_text")).alias("option_uid"),
        K.sku_uid(brand, size, F.col("colour_text"), F.col("size_text")).alias("sku_uid"), K.colour(F.col("branded")).alias("colour"),
        K.size(F.col("size_text")).alias("size"), K.store_code(F.col("colour_text")).alias("store"),
        K.zone(F.concat(brand, F.lit(" Zone "))).alias("zone"))


@query("size_scale", "p_partkey:i size:s scale:s", f"""
SELECT p_partkey, {siz('size_text')} AS size,
       CASE WHEN NOT regexp_full_match({siz('size_text')}, '\\d+') THEN 'UNKNOWN'
            WHEN TRY_CAST({siz('size_text')} AS BIGINT) BETWEEN 15 AND 55 THEN 'EU'
            WHEN TRY_CAST({siz('size_text')} AS BIGINT) BETWEEN 75 AND 99 THEN 'ALT' ELSE 'UNKNOWN' END AS scale
FROM key_texts
""")
def _scale(feed):
    return key_texts(feed).select("p_partkey", K.size(F.col("size_text")).alias("size"), K.size_scale(F.col("size_text")).alias("scale"))


@query("split_dns_item", "p_partkey:i dns:s item:s", """
SELECT p_partkey, CASE WHEN strpos(u, '_') = 0 THEN u ELSE left(u, strpos(u, '_') - 1) END AS dns,
       CASE WHEN strpos(u, '_') = 0 THEN '' ELSE substr(u, strpos(u, '_') + 1) END AS item
FROM (SELECT p_partkey, upper(CASE WHEN p_partkey % 2 = 0 THEN sized ELSE p_brand END) AS u FROM key_texts)
""")
def _split(feed):
    dns, item = K.split_dns_item(F.when(F.col("p_partkey") % 2 == 0, F.col("sized")).otherwise(F.col("p_brand")))
    return key_texts(feed).select("p_partkey", dns.alias("dns"), item.alias("item"))


B = r"^(.+?)_(\d+)_(\d+)_(.+)$"


@query("parse_branded_key", "p_partkey:i ok:i brand:s dns:s item:s colour:s option_uid:s", f"""
SELECT p_partkey, ok, CASE WHEN ok THEN trim({grab('branded', B, 1)}) ELSE '' END AS brand, CASE WHEN ok THEN {grab('branded', B, 2)} ELSE '' END AS dns,
       CASE WHEN ok THEN {grab('branded', B, 3)} ELSE '' END AS item, CASE WHEN ok THEN {col(grab('branded', B, 4))} ELSE '' END AS colour,
       CASE WHEN ok THEN {grab('branded', B, 2)} || '_' || {grab('branded', B, 3)} || '_' || {col(grab('branded', B, 4))} ELSE '' END AS option_uid
FROM (SELECT *, regexp_matches({txt('branded')}, '{B}') AS ok FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN colour_text ELSE branded END AS branded FROM key_texts))
""")
def _branded(feed):
    texts = key_texts(feed).withColumn("branded", F.when(F.col("p_partkey") % 6 == 5, F.col("colour_text")).otherwise(F.col("branded")))
    return texts.select("p_partkey", *[c.alias(n) for n, c in K.branded_key(F.col("branded")).items()])


S = r"^(\d+)_(\d+)_(.+)_(\d+)$"


@query("parse_sized_key", "p_partkey:i ok:i dns:s item:s colour:s size:s sku_uid:s", f"""
SELECT p_partkey, ok, CASE WHEN ok THEN {grab('sized', S, 1)} ELSE '' END AS dns, CASE WHEN ok THEN {grab('sized', S, 2)} ELSE '' END AS item,
       CASE WHEN ok THEN {col(grab('sized', S, 3))} ELSE '' END AS colour, CASE WHEN ok THEN {siz(grab('sized', S, 4))} ELSE '' END AS size,
       CASE WHEN ok THEN {grab('sized', S, 1)} || '_' || {grab('sized', S, 2)} || '_' || {col(grab('sized', S, 3))} || '_' || {siz(grab('sized', S, 4))} ELSE '' END AS sku_uid
FROM (SELECT *, regexp_matches({txt('sized')}, '{S}') AS ok FROM key_texts)
""")
def _sized(feed):
    return key_texts(feed).select("p_partkey", *[c.alias(n) for n, c in K.sized_key(F.col("sized")).items()])


L, H = r"^(\d+)-(\d+)-([A-Z]+)-(\d+)-(\d+)$", r"^(\d+)-(\d+)-(\d+)$"


@query("parse_itemnumber", "p_partkey:i ok:i dns:s item:s colour:s size:s", f"""
SELECT p_partkey, is_long OR is_short AS ok,
       CASE WHEN is_long THEN {grab('itemnumber', L, 1)} WHEN is_short THEN {grab('itemnumber', H, 1)} ELSE '' END AS dns,
       CASE WHEN is_long THEN {grab('itemnumber', L, 2)} WHEN is_short THEN {grab('itemnumber', H, 2)} ELSE '' END AS item,
       CASE WHEN is_long THEN {grab('itemnumber', L, 3)} ELSE '' END AS colour,
       CASE WHEN is_long THEN {siz(grab('itemnumber', L, 4))} ELSE '' END AS size
FROM (SELECT *, regexp_matches({txt('itemnumber')}, '{L}') AS is_long, regexp_matches({txt('itemnumber')}, '{H}') AS is_short FROM key_texts)
""")
def _item(feed):
    return key_texts(feed).select("p_partkey", *[c.alias(n) for n, c in K.itemnumber(F.col("itemnumber")).items()])


cte("date_texts", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
       CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') WHEN 3 THEN '########' WHEN 4 THEN '  '
            WHEN 5 THEN 'not a date' ELSE '2024-13-45' END AS cell
FROM orders
""")


def date_texts(feed):
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate").cast("timestamp")
    cell = (
        F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 3, "########").when(k == 4, "  ")
        .when(k == 5, "not a date").otherwise("2024-13-45")
    )
    return feed.raw("orders").select("o_orderkey", cell.alias("cell"))


@query("parse_dates", "o_orderkey:i day:d", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN day END AS day FROM date_texts
""")
def _dates(feed):
    return date_texts(feed).select("o_orderkey", V.parse_date(F.col("cell")).alias("day"))


@query("date_artifacts", "artifact:i n_cells:i", """
SELECT regexp_full_match(trim(cell), '#+') AS artifact, count(*) AS n_cells FROM date_texts GROUP BY 1
""")
def _artifacts(feed):
    return date_texts(feed).groupBy(V.is_date_artifact(F.col("cell")).alias("artifact")).agg(F.count("*").alias("n_cells"))


@query("numeric_coercion", "p_partkey:i value:f", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE p_size END AS value FROM part
""")
def _numbers(feed):
    k = F.col("p_partkey") % 4
    cell = (F.when(k == 0, F.col("p_retailprice").cast("string")).when(k == 1, " ").when(k == 2, "n/a")
            .otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))))
    return feed.raw("part").select("p_partkey", V.number(cell).alias("value"))


@query("lead_day_columns", "vendor:s lines:i lead_days_actual:i lead_days_promised:i days_late:i on_time:i", """
SELECT vendor, count(*) AS lines, sum(date_diff('day', order_date, date)) AS lead_days_actual,
       sum(date_diff('day', order_date, promised_date)) AS lead_days_promised, sum(date_diff('day', promised_date, date)) AS days_late,
       count(*) FILTER (WHERE date <= promised_date) AS on_time
FROM goods_receipts GROUP BY 1
""")
def _lead(feed):
    return lead_columns(feed.goods_receipts).groupBy(F.col("Vendor_Name").alias("vendor")).agg(
        F.count("*").alias("lines"), F.sum("lead_days_actual").alias("lead_days_actual"),
        F.sum("lead_days_promised").alias("lead_days_promised"), F.sum("days_late").alias("days_late"),
        F.count_if("on_time").alias("on_time"))


cte("keyed_ids", """
SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 3 THEN 'XYZ' || s_suppkey
       WHEN s_suppkey % 10 = 0 THEN 'gus' || replace(lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0'), '0', 'O')
       WHEN s_suppkey % 7 = 1 THEN 'GUS ' || replace(lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0'), '1', 'l')
       ELSE 'GUS' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') END AS raw_id
FROM supplier
""")
cte("id_master", """
SELECT 'GUS' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS known FROM supplier
UNION SELECT 'GUS' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), 'O') FROM supplier WHERE s_suppkey % 20 = 0
""")


@query("repair_store_id", "raw_id:s store_id:s repaired:i", r"""
WITH ids AS (SELECT DISTINCT raw_id, replace(upper(trim(raw_id)), ' ', '') AS id FROM keyed_ids),
parts AS (SELECT *, regexp_extract(id, '^(.*[A-HJKMNPR-Z])([0-9OQIL]+)$', 1) AS head, regexp_extract(id, '^(.*[A-HJKMNPR-Z])([0-9OQIL]+)$', 2) AS run
          FROM ids WHERE id NOT IN (SELECT known FROM id_master)),
hits AS (SELECT id, count(*) AS n, min(known) AS sole FROM (SELECT DISTINCT id, head, run FROM parts) JOIN id_master
         ON run <> '' AND regexp_full_match(known, head || replace(replace(replace(replace(run, 'O', '[O0]'), 'Q', '[Q0]'), 'I', '[I1]'), 'L', '[L1]')) GROUP BY id)
SELECT raw_id, CASE WHEN n = 1 THEN sole ELSE ids.id END AS store_id, coalesce(n = 1, false) AS repaired FROM ids LEFT JOIN hits ON hits.id = ids.id
""")
def _repair(feed):
    key = F.col("s_suppkey")
    digits = F.lpad(key.cast("string"), F.greatest(F.lit(3), F.length(key.cast("string"))), F.lit("0"))
    raw = (
        F.when(key % 11 == 3, F.concat(F.lit("XYZ"), key.cast("string")))
        .when(key % 10 == 0, F.concat(F.lit("gus"), F.replace(digits, F.lit("0"), F.lit("O"))))
        .when(key % 7 == 1, F.concat(F.lit("GUS "), F.replace(digits, F.lit("1"), F.lit("l"))))
        .otherwise(F.concat(F.lit("GUS"), digits))
    )
    letters = F.lpad(key.cast("string"), F.greatest(F.lit(3), F.length(key.cast("string"))), F.lit("O"))
    supplier = feed.raw("supplier")
    master = supplier.select(F.concat(F.lit("GUS"), digits).alias("store_id")).unionByName(
        supplier.filter(key % 20 == 0).select(F.concat(F.lit("GUS"), letters).alias("store_id")))
    return I.repair_store_ids(supplier.select(raw.alias("raw")), "raw", master)


@query("colour_bridge", "colour_code:s colour_norm:s n_rows:i ambiguous:i", f"""
SELECT *, count(*) OVER (PARTITION BY colour_code) > 1 AS ambiguous FROM (
SELECT {txt('p_brand')} AS colour_code, {col("replace(p_name, ' ', '/')")} AS colour_norm, count(*) AS n_rows FROM part GROUP BY 1, 2)
""")
def _bridge(feed):
    return I.colour_bridge(feed.raw("part").select(F.col("p_brand").alias("color"), F.replace("p_name", F.lit(" "), F.lit("/")).alias("cname")))


@query("near_duplicates", "first_value:s second_value:s", f"""
WITH v AS (SELECT DISTINCT {txt('x')} AS v FROM (SELECT p_brand AS x FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation))
SELECT a.v AS first_value, b.v AS second_value FROM v a JOIN v b ON a.v < b.v AND abs(length(a.v) - length(b.v)) <= 1 AND levenshtein(a.v, b.v) <= 1
""")
def _near(feed):
    part = feed.raw("part")
    names = part.select(F.col("p_brand").alias("x")).unionByName(part.select(F.col("p_name").alias("x"))).unionByName(
        feed.raw("nation").select(F.col("n_name").alias("x")))
    return I.near_duplicates(names, "x")
