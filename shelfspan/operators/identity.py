"""Store-id repair against the master, the colour bridge and near-duplicate values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan.functions import keys as K

# Letters read as digits in hand-keyed codes.
LETTERS, DIGITS = "OQIL", "0011"
RUN = "^(.*[A-HJKMNPR-Z])([0-9OQIL]+)$"


def _split_run(column: str) -> tuple:
    return F.regexp_extract(column, RUN, 1), F.regexp_extract(column, RUN, 2)


def _readable(seen, known):
    """Wherever the two differ the master must hold the digit."""
    return (seen == known) | known.rlike("[0-9]")


def repair_store_ids(ids: DataFrame, column: str, master: DataFrame) -> DataFrame:
    """Distinct raw ids with their ``store_id`` and whether it was repaired.

    An id outside the master moves only when reading some of its trailing letters as
    digits meets exactly one master id.  Both sides meet on the run with every letter
    folded to its digit: one equi-join over distinct ids.
    """
    raw = ids.select(F.col(column).alias("raw_id")).distinct().withColumn("id", K.store_code(F.col("raw_id")))
    known = master.select(F.col("store_id").alias("known")).distinct()
    outside = raw.select("id").distinct().join(known, F.col("id") == F.col("known"), "left_anti")
    head, run = _split_run("id")
    suspects = outside.select("id", head.alias("head"), run.alias("run")).filter(
        F.length(F.regexp_replace("run", "[0-9]", "")) > 0
    ).withColumn("folded", F.translate("run", LETTERS, DIGITS))
    known_head, known_run = _split_run("known")
    targets = known.select("known", known_head.alias("head"), known_run.alias("known_run")).withColumn(
        "folded", F.translate("known_run", LETTERS, DIGITS)
    )
    unique = (
        suspects.join(targets, ["head", "folded"])
        .withColumn("taken", F.zip_with(F.split("run", ""), F.split("known_run", ""), _readable))
        .filter(F.forall("taken", lambda ok: ok))
        .groupBy("id").agg(F.count("*").alias("landing_spots"), F.min("known").alias("only"))
        .filter("landing_spots = 1")
    )
    return raw.join(unique, "id", "left").select(
        "raw_id", F.coalesce("only", "id").alias("store_id"), F.col("only").isNotNull().alias("repaired")
    )


def colour_bridge(pending: DataFrame, code: str = "color", name: str = "cname") -> DataFrame:
    """Colour code to colour name, ``ambiguous`` where a code has several names."""
    counts = (
        pending.select(K.text(F.col(code)).alias("colour_code"), K.colour(F.col(name)).alias("colour_norm"))
        .groupBy("colour_code", "colour_norm").agg(F.count("*").alias("n_rows"))
    )
    names = F.count("*").over(Window.partitionBy("colour_code"))
    return counts.withColumn("ambiguous", names > 1)


def near_duplicates(values: DataFrame, column: str) -> DataFrame:
    """Distinct normalised values one substitution, insertion or deletion apart.

    Values meet on themselves with one character left out: at the same position for a
    substitution, on the bare shortened text for an insertion.  Every meeting is an
    answer, so nothing is compared that is not reported.
    """
    distinct = values.select(K.text(F.col(column)).alias("v")).filter("v <> ''").distinct()
    shortened = distinct.select(
        "v", F.explode(F.sequence(F.lit(1), F.length("v"))).alias("i")
    ).withColumn("rest", F.concat(F.expr("substring(v, 1, i - 1)"), F.expr("substring(v, i + 1)")))
    left, right = shortened.alias("l"), shortened.alias("r")
    swapped = left.join(
        right, (F.col("l.i") == F.col("r.i")) & (F.col("l.rest") == F.col("r.rest")) & (F.col("l.v") < F.col("r.v"))
    ).select(F.col("l.v").alias("first_value"), F.col("r.v").alias("second_value"))
    grown = shortened.select(F.col("v").alias("long"), "rest").distinct().join(
        distinct.select(F.col("v").alias("short")), F.col("rest") == F.col("short")
    ).select(F.least("long", "short").alias("first_value"), F.greatest("long", "short").alias("second_value"))
    return swapped.unionByName(grown).distinct()

