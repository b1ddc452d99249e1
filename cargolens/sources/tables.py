"""Typed reads, published writes and file digests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Logical tables of the library and their fixed columns.
SCHEMAS: dict[str, str] = {
    "demand": "date DATE, region STRING, sku STRING, quantity DOUBLE",
    "warehouse_orders": "date DATE, order_id STRING, sku STRING, quantity DOUBLE",
    "cities": "city_id STRING, x_km DOUBLE, y_km DOUBLE, demand DOUBLE",
    "waybills": "customer_id STRING, waybill_id STRING, date DATE, quantity DOUBLE",
    "business_volume": "customer_id STRING, business_volume DOUBLE",
    "deliveries": "order_id STRING, city STRING, ds STRING, accept_time STRING, delivery_time STRING",
    "catalog": "id STRING, title STRING, competition STRING, type STRING, url STRING, priority STRING, "
               "value STRING, limitation STRING, next_action STRING, verification STRING, checked_at STRING",
}


class ContractError(ValueError):
    """An input breaks its table contract."""


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
               required: list[str] | None = None, fmt: str = "csv") -> DataFrame:
    """Read with a fixed schema: identifiers stay text, malformed rows fail, columns must exist.

    ``fmt="json"`` reads a document whose ``resources`` array holds the rows; parquet carries its
    own types, which must be those of the schema if one is given.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        if schema is None:
            _require_columns(df.columns, list(required or []), path)
            return df
        declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        _require_columns(df.columns, declared.fieldNames() if required is None else list(required), path)
        have = {f.name: f.dataType for f in df.schema}
        wrong = [f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}"
                 for f in declared if f.name in have and have[f.name] != f.dataType]
        if wrong:
            raise ContractError(f"{path}: {', '.join(wrong)}")
        return df.select(*[f.name for f in declared if f.name in have])
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    required = want.fieldNames() if required is None else list(required)
    if fmt == "json":
        document = T.StructType([T.StructField("resources", T.ArrayType(want))])
        df = (spark.read.schema(document).option("multiLine", True).option("mode", "FAILFAST").json(path))
        return df.select(F.inline("resources"))
    header = spark.read.option("header", True).csv(path).columns
    _require_columns(header, required, path)
    # Read every declared column by its header position, then keep the declared ones.
    by_name = {f.name: f for f in want}
    physical = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
    df = (spark.read.schema(physical).option("header", True).option("enforceSchema", False)
          .option("mode", "FAILFAST").csv(path))
    return df.select(*[c for c in header if c in by_name])


def _require_columns(have: list[str], required: list[str], path: str) -> None:
    missing = sorted(set(required) - set(have))
    if missing:
        raise ContractError(f"{path}: missing columns {missing}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result; doubles are rounded to six decimals in the CSV form."""
    if fmt != "csv":
        df.write.mode("overwrite").format(fmt).save(path)
        return
    text = df.select(*[
        F.when(F.col(f.name).isNotNull(), F.format_string("%.6f", f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema])
    text.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


#: Bytes of a file that a task holds while it hashes.
BLOCK = 4 << 20


def _hash_streams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sizes, hashes = [], []
        for uri in frame["uri"]:
            system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(place) as stream:
                while block := stream.read(BLOCK):
                    digest.update(block)
                    size += len(block)
            sizes.append(size)
            hashes.append(digest.hexdigest())
        yield pd.DataFrame({"path": frame["path"], "bytes": sizes, "sha256": hashes})


def file_digest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SHA-256 and size of every file below ``path``, named by its path from there; hashed on the executors.

    Files come from the file index that Spark keeps on the driver for any read (a scan would leave out empty ones) and
    are dealt to tasks; a task reads each of its files as a stream of ``BLOCK`` bytes, so a file may have any size.
    The file systems are those that pyarrow opens (local, hdfs, s3, gs).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", path).rstrip("/")
    uris = reader.load(path).inputFiles()
    files = spark.createDataFrame([(u, unquote(u)) for u in uris], "uri string, path string")
    hashed = (files.repartition(max(1, min(len(uris), 10_000)), "uri")
              .mapInPandas(_hash_streams, "path string, bytes long, sha256 string").withColumn("root", F.lit(root)))
    return hashed.select(F.expr("substring(path, instr(path, root) + length(root) + 1)").alias("file"), "bytes", "sha256")


def manifest_diff(recorded: DataFrame, actual: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Compare recorded digests (file, sha256[, digest_group]) with the files found now.

    ``groups`` lists digest groups that must not be empty.
    """
    grouped = "digest_group" in recorded.columns
    left = recorded.select(F.col("file"), F.col("sha256").alias("recorded"),
                           (F.col("digest_group") if grouped else F.lit("files")).alias("digest_group"))
    right = actual.select(F.col("file"), F.col("sha256").alias("actual"))
    status = (F.when(F.col("actual").isNull(), "missing_file")
              .when(F.col("recorded").isNull(), "not_recorded")
              .when(F.col("actual") != F.col("recorded"), "changed")
              .otherwise("same"))
    out = (left.join(right, "file", "full_outer")
           .select("file", F.coalesce("digest_group", F.lit("files")).alias("digest_group"),
                   "recorded", "actual", status.alias("status")))
    if groups:
        expected = recorded.sparkSession.createDataFrame([(g,) for g in groups], "digest_group string")
        empty = expected.join(left.select("digest_group").distinct(), "digest_group", "left_anti")
        out = out.unionByName(empty.select(
            F.lit(None).cast("string").alias("file"), "digest_group",
            F.lit(None).cast("string").alias("recorded"), F.lit(None).cast("string").alias("actual"),
            F.lit("empty_group").alias("status")))
    return out
