"""Expressions and helpers that several operators share. Words are runs of characters other than ASCII white space."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Python workers started from here on find this package where it lies."""
    own = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    settings = spark.sparkContext.environment
    known = [path for path in settings.get("PYTHONPATH", "").split(os.pathsep) if path]
    if own not in known:
        settings["PYTHONPATH"] = os.pathsep.join([own, *known])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1 ..., so that none clashes with an operator's own, and the new names."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equal join in which both sides get a shuffle of their own.

    A side that was grouped by the same keys would be joined where it lies, and adaptive execution
    cannot split a hot key of such a join. A hash of the keys as one more key makes it shuffle again.
    """
    hashed = F.xxhash64(*[F.col(k) for k in keys])
    joined = left.withColumn("_join_hash", hashed).join(
        right.withColumn("_join_hash", hashed), [*keys, "_join_hash"], how
    )
    return joined.drop("_join_hash")


def packed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the strings of a column compressed one by one, for a shuffle; null stays null.

    The other side of the join should have the hint "merge": with a broadcast the packing is wasted, and the
    workers of two Python steps stand side by side in one stage.
    """
    fields = [T.StructField(column, T.BinaryType()) if f.name == column else f for f in df.schema.fields]
    schema, at = T.StructType(fields), df.columns.index(column)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            columns = list(batch.columns)
            small = [press.compress(x.as_buffer()) if x.is_valid else None for x in columns[at]]
            columns[at] = pa.array(small, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(pack, schema)


def unpacked(column: pa.Array) -> pa.Array:
    """The strings of a column that was packed."""
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x.as_buffer()) if x.is_valid else None for x in column], pa.binary()).view(pa.string())


def written(spark: SparkSession, df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and read again after a lost executor."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
