"""A kept inverted index: postings in buckets of their terms, brought up to date document by document."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import search

#: Buckets of terms; a batch of queries reads only those of its terms' first two characters.
BUCKETS = 64


def _bucket(term):
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


class Index:
    """Postings under ``root``, one folder per version; the file ``current`` names the one that counts.

    A version is written beside the others and named last, so that a failure in between leaves the former one valid.
    Buckets hold terms of like beginnings, so that prefix search reads few of them; rows of a bucket are spread over
    files by document, so that a common beginning makes no large task.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> str | None:
        fs, p = self._fs(f"{self.root}/current")
        return self.spark.read.text(f"{self.root}/current").first()[0] if fs.exists(p) else None

    def _write(self, postings: DataFrame, lengths: DataFrame) -> None:
        name, old = uuid.uuid4().hex, self.version()
        postings.withColumn("bucket", _bucket("term")).write.partitionBy("bucket").parquet(f"{self.root}/{name}/postings")
        lengths.write.parquet(f"{self.root}/{name}/lengths")
        self.spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/current")
        if old:
            fs, p = self._fs(f"{self.root}/{old}")
            fs.delete(p, True)

    @staticmethod
    def _lengths(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
        return df.select(F.col(key).alias("doc"), F.size(search.tokens(F.concat_ws(" ", *fields))).alias("len"))

    def build(self, df: DataFrame, key: str, *fields: str) -> None:
        """Index of all rows of ``df``; keys must be unique."""
        self._write(search.postings(df, key, *fields), self._lengths(df, key, fields))

    def update(self, changed: DataFrame, gone: DataFrame, key: str, *fields: str) -> None:
        """Index after ``changed`` rows were added or took the place of those of their key and the keys ``gone`` were removed."""
        out = changed.select(F.col(key).alias("doc")).unionByName(gone.select(F.col(key).alias("doc"))).distinct()
        postings = self.postings().join(out, "doc", "left_anti").unionByName(search.postings(changed, key, *fields))
        lengths = self.lengths().join(out, "doc", "left_anti").unionByName(self._lengths(changed, key, fields))
        self._write(postings, lengths)

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """doc, term, tf, len; of the buckets of ``terms`` (qterm) alone, if given."""
        p = self.spark.read.parquet(f"{self.root}/{self.version()}/postings")
        if terms is not None:
            p = p.where(F.col("bucket").isin([r[0] for r in terms.select(_bucket("qterm")).distinct().collect()]))  # BUCKETS at most
        return p.drop("bucket")

    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.version()}/lengths")

    def search(self, queries: DataFrame, text: str = "text", prefix: bool = True, all_terms: bool = False) -> DataFrame:
        """query_id, doc, score of a batch of queries."""
        terms = search.query_terms(queries, text)
        corpus = self.lengths().agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
        return search.bm25(self.postings(terms), corpus, queries, text, prefix, all_terms)
