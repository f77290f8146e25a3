"""CSV in and out, directory manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.session import shared_dir


# A quote inside a value is doubled.
CSV = {"header": True, "quote": '"', "escape": '"'}


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in shared storage that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/bitloom/{label}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    """Named columns of CSV files with a header; the others are not parsed.

    Quoted values may hold line breaks, quotes and commas. An empty field without
    quotes is null, a quoted one is an empty text. Files with line breaks in values
    cannot be split, so large tables should be many files.
    """
    options = CSV | {"multiLine": True, "nullValue": "\0", "emptyValue": ""}
    return spark.read.schema(schema).options(**options).csv(path).select(*columns)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Write CSV with a header as one file per partition, to be read back by ``read_csv``."""
    options = CSV | {"nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (df.select(*columns) if columns else df).write.options(**options).csv(path)


def dir_manifest(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """One record per file with an extension, found recursively; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{extension}")
        .load(folder)
    )
    return files.select(
        F.sha1("path").alias("id"),
        "path",
        F.element_at(F.split("path", "/"), -1).alias("item"),
        "length",
        F.lit("waiting").alias("status"),
    )


def staging_manifest(items: DataFrame, processed: DataFrame, key: str, kind: str, supported: list[str]) -> DataFrame:
    """Where each staged item stands.

    ``processed`` has one row per attempted item with a flag ``ok``. Items of an
    unsupported kind are set apart, failed ones are due again.
    """
    status = (
        F.when(~F.col(kind).isin(supported), "unsupported")
        .when(F.col("ok").isNull(), "waiting")
        .when(F.col("ok"), "done")
        .otherwise("retry")
    )
    joined = items.join(processed.select(key, "ok"), key, "left")
    return joined.select(key, F.sha1(F.col(key).cast("string")).alias("id"), kind, status.alias("status"))
