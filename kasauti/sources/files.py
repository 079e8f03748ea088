"""File sources and sinks: CSV with a byte-order mark or JSON columns, JSON, JSON lines, one file for each perturbation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workbooks import read_xlsx

#: Where a normalised claim column may come from, first non-empty first. Fixed values.
ALIASES = {
    "claim": ["claim", "claim_text", "Claim", "claim1"],
    "evidence": ["evidence", "evidence_text", "Evidence", "evidence1"],
    "label": ["label", "gold_label", "Label"],
    "language": ["language", "lang", "Language"],
    "domain": ["domain", "Domain"],
}
FLAGS = T.StructType([T.StructField(n, T.BooleanType()) for n in ("fluency_checked", "label_consistent", "meaning_preserved")])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-driven, all strings; a byte-order mark before the first name is taken off."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    return raw.toDF(*[c.lstrip("﻿") for c in raw.columns])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_per_attack(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder but attacked_rows_all.csv, with attack_id from the file's name."""
    files = read_csv(spark, f"{folder}/*.csv").select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("attack_file"))
    return files.filter(F.col("attack_file") != "attacked_rows_all")


def parse_json_columns(df: DataFrame) -> DataFrame:
    """technique_params as a map and validity_flags as a struct; where the text is no JSON, null, and the text in technique_params_text or validity_flags_text."""
    kept = {f"{c}_text": F.when(F.try_parse_json(F.col(c)).isNull(), F.col(c)) for c in ("technique_params", "validity_flags")}
    return df.withColumns(kept | {"technique_params": F.from_json("technique_params", "map<string,string>"), "validity_flags": F.from_json("validity_flags", FLAGS)})


def first_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """At most ``limit`` rows in the file's order; all without one or with 0."""
    return df.limit(limit) if limit else df


def pick(df: DataFrame, name: str) -> Column:
    """The first alias of ``name`` that is there and not empty, else ''."""
    present = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in ALIASES[name] if c in df.columns]
    return F.coalesce(*present, F.lit(""))


def write_per_attack(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").partitionBy("attack_id").option("header", True).csv(folder)


def write_all(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def write_summary(df: DataFrame, folder: str) -> None:
    """Each row as one JSON object."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)


def append_audit(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


__all__ = ["append_audit", "first_rows", "parse_json_columns", "pick", "read_csv", "read_json", "read_per_attack", "read_xlsx", "write_all", "write_per_attack", "write_summary"]
