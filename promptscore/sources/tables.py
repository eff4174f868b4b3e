"""Parquet tables in a shared folder: append by part, publish in order, check what is committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a table written to ``path`` was committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def uri(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as pyarrow names it (``file:///...`` for local paths)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    qualified = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    if qualified.startswith("file:/") and not qualified.startswith("file:///"):
        qualified = "file:///" + qualified[len("file:/") :].lstrip("/")
    return qualified


def put(df: DataFrame, path: str) -> None:
    """Write one part of a table under its own path; writing it again replaces it."""
    df.write.mode("overwrite").parquet(path)


def get(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def publish(prompts: DataFrame, batches: DataFrame, root: str) -> None:
    """Append prompts first and batch rows last: readers that require the batch row never see half a batch."""
    prompts.write.mode("append").parquet(f"{root}/prompts")
    batches.write.mode("append").parquet(f"{root}/batches")


def put_results(documents: DataFrame, root: str, part: str) -> None:
    """Write result documents as a parquet part, for the completion guard of the next run."""
    put(documents, f"{root}/results/{part}")


def export_json(documents: DataFrame, path: str) -> None:
    """Result documents as files of one JSON document per line."""
    documents.select("result").write.mode("overwrite").text(path)
