"""Job profile (A12, N6, C8, L12): labels, detection mode, exceptions, index option."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_MODE, DETECTION_MODES

PROFILE_SCHEMA = ("struct<labels:array<string>,detection_mode:string,exceptions:string,"
                  "include_kept_in_index:boolean>")


def parse_profile(json_col: Column) -> Column:
    """JSON text -> profile struct with defaults; an unknown mode becomes the default."""
    p = F.from_json(json_col, PROFILE_SCHEMA)
    mode = F.coalesce(p["detection_mode"], F.lit(DEFAULT_MODE))
    return F.struct(
        F.coalesce(p["labels"], F.array().cast("array<string>")).alias("labels"),
        F.when(mode.isin(list(DETECTION_MODES)), mode).otherwise(F.lit(DEFAULT_MODE)).alias("detection_mode"),
        F.coalesce(p["exceptions"], F.lit("")).alias("exceptions"),
        F.coalesce(p["include_kept_in_index"], F.lit(False)).alias("include_kept_in_index"))


def profile_payload(labels: Column, mode: Column, exceptions: Column, include_kept: Column) -> Column:
    """Profile struct -> JSON text (labels sorted)."""
    return F.to_json(F.struct(F.array_sort(labels).alias("labels"), mode.alias("detection_mode"),
                              exceptions.alias("exceptions"), include_kept.alias("include_kept_in_index")))


def mode_threshold(mode: Column) -> Column:
    """Detection mode -> minimum model score (unknown -> default mode)."""
    m = F.create_map(*[F.lit(x) for kv in DETECTION_MODES.items() for x in kv])
    return F.coalesce(m[mode], m[F.lit(DEFAULT_MODE)])


def parse_terms(raw: Column) -> Column:
    """Comma-separated exceptions -> trimmed, non-empty terms."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))),
                    lambda x: x != "")


def read_profiles(spark, path: str):
    """Profile JSON files (one object per file) -> one row per file with defaults applied."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(parse_profile(F.col("value")).alias("p")).select("p.*")


def write_profiles(df, path: str) -> None:
    """Rows (labels, detection_mode, exceptions, include_kept_in_index) -> JSON lines."""
    df.select(profile_payload(F.col("labels"), F.col("detection_mode"), F.col("exceptions"),
                              F.col("include_kept_in_index")).alias("value")).write.mode("overwrite").text(path)
