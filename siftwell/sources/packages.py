"""Knowledge-base packages: gzip JSON tables with a manifest and checksums, and plain JSON exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1


def checksum(df: DataFrame) -> DataFrame:
    """One row: rows and the sum of their 64-bit hashes, which does not depend on their order."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table as gzip JSON, and a manifest (table, n_rows, checksum, schema, version) read back from what was written."""
    from functools import reduce

    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}", compression="gzip")
        back = spark.read.schema(df.schema).json(f"{path}/{name}")
        parts.append(checksum(back).select(F.lit(name).alias("table"), "n_rows", "checksum", F.lit(df.schema.json()).alias("schema"), F.lit(FORMAT_VERSION).alias("version")))
    reduce(DataFrame.unionByName, parts).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table string, n_rows long, checksum string, schema string, version int").json(f"{path}/manifest")


def install(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """Tables of a package; a wrong version or checksum raises."""
    from pyspark.sql.types import StructType

    out = {}
    for r in manifest(spark, path).collect():  # one row per table
        if r.version != FORMAT_VERSION:
            raise ValueError(f"package format {r.version}, not {FORMAT_VERSION}")
        df = spark.read.schema(StructType.fromJson(json.loads(r.schema))).json(f"{path}/{r.table}")
        if verify:
            got = checksum(df).first()
            if (got.n_rows, got.checksum) != (r.n_rows, r.checksum):
                raise ValueError(f"{r.table}: {got.n_rows} rows, checksum {got.checksum}; the manifest has {r.n_rows}, {r.checksum}")
        out[r.table] = df
    return out


def type_histogram(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n"))
