"""Expressions and small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import read_table

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def hash60(column: Column) -> Column:
    """The first 60 bits of MD5 as a non-negative long; null hashes as its own value.

    MD5 because any SQL engine can recompute it; 60 bits because fifteen hex
    digits convert to a signed long without overflow.
    """
    tagged = F.when(column.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), column.cast("string")))
    return F.conv(F.substring(F.md5(tagged), 1, 15), 16, 10).cast("long")


def crc_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus`` (null: its empty text)."""
    return (F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % F.lit(modulus)).cast("int")


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
