"""Scans, filters and changes of entity-like tables.

Tables are immutable: every change returns the new table as a plan, to be written by the caller.
Where the order of equal rows matters the id settles it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """One row per key: the one with the latest ``order`` (nulls last); of equal rows any."""
    pick = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))
    return df.withColumn("_n", F.row_number().over(pick)).where("_n = 1").drop("_n")


def by_name(df: DataFrame, name: str, type_: str | None = None) -> DataFrame:
    """The entity of that name (and type) with the least id."""
    hits = df.where(F.col("name") == name)
    return (hits if type_ is None else hits.where(F.col("type") == type_)).orderBy("id").limit(1)


def by_file(df: DataFrame, path: str) -> DataFrame:
    return df.where(F.col("file_path") == path).orderBy("start_line", "id")


def by_type(df: DataFrame, *types: str) -> DataFrame:
    return df.where(F.col("type").isin(*types))


def by_hash(df: DataFrame, hash_: str) -> DataFrame:
    return df.where(F.col("hash") == hash_)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page in the order of name and id."""
    return df.orderBy("name", "id").offset(offset).limit(limit)


def page_after(df: DataFrame, last_id: str | None, size: int = 500) -> DataFrame:
    """The next page in the order of id; the key of the last row seen leads to it, so no rows are skipped over."""
    return (df if last_id is None else df.where(F.col("id") > last_id)).orderBy("id").limit(size)


def in_file(df: DataFrame, part: str, type_: str | None = None) -> DataFrame:
    """Entities whose path holds ``part``."""
    hits = df.where(F.instr("file_path", part) > 0)
    return (hits if type_ is None else hits.where(F.col("type") == type_)).orderBy("file_path", "start_line", "id")


def instructions(df: DataFrame, tag: str | None = None, priority: str | None = None, active_only: bool = True) -> DataFrame:
    """Team instructions, kept as entities with tags (comma list), priority and active in their metadata."""
    meta = F.col("metadata")
    out = df.where(F.col("type") == "instruction")
    if active_only:
        out = out.where(F.coalesce(meta["active"], F.lit("true")) != "false")
    if priority:
        out = out.where(F.coalesce(meta["priority"], F.lit("normal")) == priority)
    if tag:
        out = out.where(F.array_contains(F.split(F.coalesce(meta["tags"], F.lit("")), r"\s*,\s*"), tag))
    return out


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def upsert(df: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """Rows replace those of the same keys but for the ``keep`` columns; others are added. Keys compare null-safe.

    ``rows`` has one row per key; repeated ones should be reduced before (:func:`latest`).
    """
    cols = df.columns
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    old = df.withColumn("_o", F.lit(True)).alias("o")
    new = rows.withColumn("_n", F.lit(True)).alias("n")

    def pick(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"o.{c}")
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return old.join(new, on, "full").select(*[pick(c).alias(c) for c in cols])


def merge_metadata(old: Column, new: Column) -> Column:
    """Shallow merge of two maps; keys of the new one win, a null counts as empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def update(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial update by id: columns of ``changes`` that are not null take over, metadata is merged, and new content is hashed anew."""
    from siftwell.functions.text import content_hash

    have = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in have])
    out = df.join(new, "id", "left")
    for c in have:
        out = out.withColumn(c, F.when(F.col(f"_{c}").isNotNull(), merge_metadata(F.col(c), F.col("_metadata"))).otherwise(F.col(c)) if c == "metadata" else F.coalesce(f"_{c}", c))
    if "content" in have and "hash" in df.columns:
        out = out.withColumn("hash", F.when(F.col("_content").isNotNull(), content_hash(F.col("content"))).otherwise(F.col("hash")))
    return out.select(*df.columns)


def set_columns(df: DataFrame, ids: DataFrame, values: dict[str, Column], key: str = "id") -> DataFrame:
    """Set columns of the rows whose key is in ``ids``: marks of suggestions, tiers of memory, weights of edges, status of sessions."""
    hit = df.join(ids.select(key, F.lit(True).alias("_h")).distinct(), key, "left")
    return hit.select(*[F.when(F.col("_h"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def symbols(df: DataFrame, text: str) -> DataFrame:
    """Entities whose path, name or summary holds the text, case aside."""
    low = text.lower()
    return df.where(F.greatest(*[F.coalesce(F.instr(F.lower(c), low), F.lit(0)) for c in ("file_path", "name", "summary")]) > 0)


def delete(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Without the rows whose key is in ``gone``; rows of a null key stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def deleted(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """How many rows ``delete`` takes away for each key that it finds: key, n_deleted."""
    return df.join(gone.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n_deleted"))


def delete_cascade(entities: DataFrame, edges: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities without those in ``gone`` (id), edges without an end in it, and vectors without an entity in it."""
    ids = gone.select("id").distinct()
    left = edges
    for end in ("source_id", "target_id"):
        left = left.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return delete(entities, ids), left.select(*edges.columns), vectors.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(*vectors.columns)


def store_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Adds chunk vectors; a new chunk 0 first takes away all chunks of its entity and model, any other one its own."""
    first = new.where("chunk_index = 0").select("entity_id", "model_id").distinct()
    kept = vectors.join(first, ["entity_id", "model_id"], "left_anti").join(new.select("entity_id", "model_id", "chunk_index"), ["entity_id", "model_id", "chunk_index"], "left_anti")
    return kept.select(*vectors.columns).unionByName(new.select(*vectors.columns))


def keep_latest(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def next_number(df: DataFrame, key: str, number: str) -> DataFrame:
    """key and the number after the greatest one it has."""
    return df.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))
