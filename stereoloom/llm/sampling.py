"""Bounded, repeatable samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_hash(df: DataFrame, id_column: str, most: int) -> DataFrame:
    """The rows with the ``most`` smallest hashes of the id (all rows if there are fewer).

    Only hashes go to the driver, ``most`` of them at a time and one in the
    end; the choice does not depend on files, partitions or row order. Rows
    that repeat the last id are all kept.
    """
    key = F.xxhash64(F.col(id_column).cast("string"))
    last = df.select(key.alias("h")).orderBy("h").limit(most).agg(F.max("h"), F.count("*")).first()
    return df.filter(key <= F.lit(last[0])) if last[1] >= most else df


def held_out(id_column: str, of: int, remainder: int):
    """crc32 of the id as text, modulo ``of``, equals ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % of == remainder
