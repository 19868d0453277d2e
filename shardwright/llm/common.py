"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.session import cut, ensure_checkpoint_dir, stored

__all__ = ["WORD_TABLE", "crc_bucket", "cut", "ensure_checkpoint_dir", "release", "shielded", "stored", "table", "words_of"]

#: Bytes that are no word characters become blanks, A-Z become a-z; all bytes
#: of other characters stay.
WORD_TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps that are written and done with: it does so once the driver's objects of them are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of a value's text, modulo ``modulus``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(WORD_TABLE).split() if text else []


def shielded(docs: DataFrame, own: set[str], added: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with neutral names for all columns but ``own`` that clash with ``added``, and what gives the old columns back."""
    names = docs.columns
    taken = {n.lower() for n in added}
    inner = [n if n in own or n.lower() not in taken else f"__kept_{i}" for i, n in enumerate(names)]
    return docs.toDF(*inner), lambda df: df.select(*inner).toDF(*names)
