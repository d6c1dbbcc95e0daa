"""Session helpers: table access, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the data model: space, tab, CR, LF and form feed.
WHITE = " \\t\\r\\n\\f"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder (one Parquet file or folder each)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is read in fewer parts than there are cores, for stages that compute much per row.

    Such a table is small (a part has at most ``spark.sql.files.maxPartitionBytes``); larger ones stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``. Only a session that runs on one machine may do without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", path)
    # each application has a folder of its own, so that clearing it leaves those of others alone
    return f"{path.rstrip('/')}/siftwell/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    It cuts the lineage and survives the loss of executors. Unlike ``checkpoint()`` the
    plan runs once, the files are columnar, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that this application wrote by :func:`materialize`; results built on them must have been stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stripped(c: Column) -> Column:
    """``c`` without white space at both ends."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def is_blank(c: Column) -> Column:
    """True where ``c`` is null or holds white space only."""
    return c.isNull() | ~c.rlike(f"[^{WHITE}]")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
