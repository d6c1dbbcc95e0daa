"""Cosine similarity and exact nearest-neighbour search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if their lengths differ or one is null or all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.coalesce(F.when(ok, dot(a, b) / norm), F.lit(0.0))


#: Most query vectors that travel to every task (64 MB at 1,024 doubles).
QUERIES = 8_192
#: Query vectors that are compared with a batch of rows at once.
AT_ONCE = 512
#: Rows of a block where blocks meet pairwise.
BLOCK = 2_048


def _units(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; all zero where a row is unusable."""
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.linalg.norm(m, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return np.where(ok[:, None], m / np.where(ok, norm, 1)[:, None], 0.0)


def _by_size(ids: list, vectors: list) -> dict[int, tuple[list, np.ndarray]]:
    """Query ids and their vectors, scaled to length 1, for each count of numbers."""
    out: dict[int, tuple[list, np.ndarray]] = {}
    for n in {len(v) for v in vectors if v is not None and len(v)}:
        at = [i for i, v in enumerate(vectors) if v is not None and len(v) == n]
        m = np.array([vectors[i] for i in at], dtype=float)
        out[n] = [ids[i] for i in at], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return out


def _best(b: pd.DataFrame, by_size: dict, k: int, threshold: float):
    """query_id, entity_id, score of the rows ``b`` that may be among the ``k`` best entities of each query."""
    for n, g in b.groupby(b["embedding"].map(lambda x: -1 if x is None else len(x))):
        if n not in by_size:
            continue
        ids, q = by_size[n]
        x = _units(np.stack(g["embedding"].to_numpy()).astype(float))
        code, names = pd.factorize(g["entity_id"])
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(names)))
        for i in range(0, len(q), AT_ONCE):
            # an entity among the k best of all is among the k best of the batch that holds its best chunk
            best = np.maximum.reduceat(q[i : i + AT_ONCE] @ x[order].T, first, axis=1)
            least = np.full(len(best), threshold)
            if len(names) > k:
                least = np.maximum(least, np.partition(best, len(names) - k, axis=1)[:, len(names) - k])
            r, c = np.nonzero(best >= least[:, None])
            yield pd.DataFrame({"query_id": [ids[i + j] for j in r], "entity_id": np.asarray(names)[c], "score": best[r, c]})


def knn(
    vectors: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0, model: str | None = None, allowed: DataFrame | None = None
) -> DataFrame:
    """query_id, entity_id, score, rank: the ``k`` entities whose best chunk is most similar to each query vector.

    ``vectors``: entity_id, embedding (model_id). ``queries``: query_id, vector; up to QUERIES are
    broadcast, more meet the rows in blocks of bounded size. ``allowed`` (entity_id) and ``model`` restrict
    before the search, so nothing is lost. Unusable vectors (null, zero, other length) score 0.
    """
    v = vectors.where(F.col("entity_id").isNotNull())
    v = v if model is None else v.where(F.col("model_id") == model)
    v = v if allowed is None else v.join(allowed.select("entity_id").distinct(), "entity_id", "left_semi")
    v = v.select("entity_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    qtype, etype = (d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (vectors, "entity_id")))
    schema = f"query_id {qtype}, entity_id {etype}, score double"
    asked = q.limit(QUERIES + 1).collect()
    if len(asked) > QUERIES:
        scored = _in_blocks(v, q, k, threshold, schema)
    else:
        shared = vectors.sparkSession.sparkContext.broadcast(_by_size([r.query_id for r in asked], [r.vector for r in asked]))

        def score(batches):
            for b in batches:
                yield from _best(b, shared.value, k, threshold)

        scored = v.mapInPandas(score, schema)
    best = scored.groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("entity_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _in_blocks(v: DataFrame, q: DataFrame, k: int, threshold: float, schema: str) -> DataFrame:
    """Candidates as of ``_best``, every block of queries having met every block of rows."""
    v, q = v.where(F.size("embedding") > 0).distinct(), q.where(F.size("vector") > 0).distinct()
    rows, crowds = (max(1, -(-d.count() // BLOCK)) for d in (v, q))
    part, every = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = v.withColumn("block", part(rows, "entity_id", "embedding")).withColumn("crowd", every(crowds))
    right = q.withColumn("crowd", part(crowds, "query_id", "vector")).withColumn("block", every(rows))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = list(_best(x, _by_size(y["query_id"].tolist(), y["vector"].tolist()), k, threshold)) if len(x) and len(y) else []
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "entity_id": [], "score": []})

    return left.groupBy("block", "crowd").cogroup(right.groupBy("block", "crowd")).applyInPandas(meet, schema)


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """a, b, score: every pair of entities (a < b) whose most similar chunks have a cosine of at least ``threshold``, above 0.

    ``vectors``: entity_id, embedding. All blocks of rows meet each other, so no pair is lost however many an entity
    has; the work grows with the square of the rows. Unusable vectors are in no pair.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    kind = vectors.schema["entity_id"].dataType.simpleString()
    v = vectors.where(F.col("entity_id").isNotNull() & (F.size("embedding") > 0)).select("entity_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    n = max(1, -(-v.count() // BLOCK))
    own, other = F.col("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    x = v.select("entity_id", "embedding", F.pmod(F.xxhash64("entity_id", "embedding"), F.lit(n)).cast("int").alias("own")).select("*", other)
    x = x.select("entity_id", "embedding", "own", F.least(own, F.col("other")).alias("i"), F.greatest(own, F.col("other")).alias("j"))

    def meet(where: tuple, g: pd.DataFrame) -> pd.DataFrame:
        i, j = where
        found = []
        for _, h in g.groupby(g["embedding"].map(len)):
            l, r = h[h["own"] == i], h[h["own"] == j]
            if not len(l) or not len(r):
                continue
            y, names, others = _units(np.stack(r["embedding"].to_numpy()).astype(float)), l["entity_id"].to_numpy(), r["entity_id"].to_numpy()
            z = _units(np.stack(l["embedding"].to_numpy()).astype(float))
            for s in range(0, len(z), AT_ONCE):
                cos = z[s : s + AT_ONCE] @ y.T
                at, to = np.nonzero(cos >= threshold)
                found.append(pd.DataFrame({"a": names[at + s], "b": others[to], "score": cos[at, to]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "score": []})

    met = x.groupBy("i", "j").applyInPandas(meet, f"a {kind}, b {kind}, score double").where("a <> b")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


def rolling_hash(text: str) -> int:
    """31 h + c over UTF-16 units, as a signed 32-bit number."""
    h = 0
    for c in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16).tolist():
        h = (h * 31 + c) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def mock_embedding(text: Column, dims: int = 128) -> Column:
    """A deterministic stand-in for a model: sines of multiples of a rolling hash, scaled to length 1. Null for null."""

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            v = np.sin(float(rolling_hash(t)) * np.arange(1, dims + 1) * 0.0001)
            n = np.sqrt((v * v).sum())
            return v / n if n else v

        return s.map(one)

    return embed(text)
