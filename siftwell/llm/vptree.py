"""Most similar vectors for every vector, by vantage-point trees with relaxed pruning.

Vectors are scaled to length 1, where the distance |x - y| = sqrt(2 - 2 cos) is a metric. The upper
levels of one vantage-point tree, fitted on a bounded sample, part a collection into shards; each
shard, cut into blocks of bounded size, carries a tree of its own. A search of radius r around q may
skip the near side of a vantage point p with median distance m if d(q, p) - r > m, and the far side
if d(q, p) + r < m. ``relax`` multiplies r in these tests: 1 restores exact search, less visits fewer
nodes at the risk of a miss.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.runtime import materialize

#: Rows of a collection that bound the radius of a search without a limit, rows wanted per shard, most shards of a collection (beyond
#: SHARD * SHARDS rows, 268 million, shards grow), and rows per shard that the upper tree is fitted on (SAMPLE rows at least).
SAMPLE, SHARD, SHARDS, FIT = 20_000, 32_768, 8_192, 16
#: Most rows, and most queries, that one task compares; rows of a leaf; queries searched for at once.
BLOCK, LEAF, ATONCE = 65_536, 128, 4_096


@dataclass
class Tree:
    """Complete binary tree of vantage points: node i has children 2i + 1 (near) and 2i + 2 (far)."""

    points: np.ndarray  # (nodes, dims)
    middle: np.ndarray  # (nodes,)
    depth: int

    @staticmethod
    def fit(x: np.ndarray, depth: int, tries: int = 8, seed: int = 3) -> tuple[Tree, np.ndarray]:
        """A tree over the rows of ``x`` (length 1), and the leaf of each row.

        As vantage point serves, of a few rows of the node, the one whose distances spread most.
        """
        rng = np.random.default_rng(seed)
        nodes = (1 << depth) - 1
        points, middle = np.zeros((nodes, x.shape[1]), np.float32), np.zeros(nodes, np.float32)
        place = np.zeros(len(x), np.int64)
        for level in range(depth):
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(1 << level, dtype=np.int64) + (1 << level) - 1, side="right")
            begin = 0
            for k, end in enumerate(ends):
                rows, begin, node = order[begin:end], end, (1 << level) - 1 + k
                if not len(rows):
                    continue
                some = x[rows if len(rows) <= 256 else rows[rng.integers(0, len(rows), 256)]]
                cand = x[rows[rng.integers(0, len(rows), tries)]]
                p = cand[np.argmax(distances(some, cand).std(axis=0))]
                d = distances(x[rows], p[None])[:, 0]
                points[node], middle[node] = p, np.median(d)
                place[rows] = 2 * node + 1 + (d > middle[node])
        return Tree(points, middle, depth), place - nodes

    def leaves(self, q: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves that a search from each query has to visit: (number of the query, leaf). reach: radius times relax."""
        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level in range(self.depth):
            d = np.empty(len(who), np.float32)
            order = np.argsort(node, kind="stable")
            cuts = np.flatnonzero(np.diff(node[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    d[part] = distances(q[who[part]], self.points[node[part[0]]][None])[:, 0]
            m, r = self.middle[node], reach[who]
            near, far = d - r <= m, d + r > m
            who, node = np.concatenate([who[near], who[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
        return who, node - ((1 << self.depth) - 1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def parse_json(text: Column) -> Column:
    """array<double> of a text that is valid JSON with an array at top level; null if it isn't or holds other things than numbers."""

    @F.pandas_udf("array<double>")
    def parse(s: pd.Series) -> pd.Series:
        def refuse(name):
            raise ValueError(name)

        def one(t):
            try:
                v = json.loads(t, parse_constant=refuse)
                if not isinstance(v, list) or any(isinstance(e, bool) or not isinstance(e, (int, float)) for e in v):
                    return None
                return [float(e) for e in v]
            except (ValueError, TypeError, OverflowError, RecursionError):
                return None

        return s.map(one)

    return parse(text)


def usable(df: DataFrame, vector: str, collection: str = "collection") -> DataFrame:
    """Rows whose vector has its collection's usual (commonest, then least) count of numbers, all finite and not all zero."""
    counts = df.where(F.size(vector) > 0).groupBy(collection, F.size(vector).alias("dims")).agg(F.count("*").alias("k"))
    usual = counts.groupBy(collection).agg(F.max(F.struct("k", -F.col("dims"))).alias("m")).select(collection, (-F.col("m.col2")).alias("dims"))
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    return df.join(F.broadcast(usual), collection).where((F.size(vector) == F.col("dims")) & ok).drop("dims")


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _stack(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float32).reshape(len(units), -1)


def _search(x: np.ndarray, cx: np.ndarray, q: np.ndarray, cq: np.ndarray, reach: np.ndarray, k: int, least: float) -> tuple[np.ndarray, ...]:
    """Up to ``k`` most similar rows of ``x`` for each of ``q``: (query, row, cosine). Equal codes are the row itself.

    A tree over the rows gives each query its leaves; each leaf is then compared with its queries at once.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, len(x) / LEAF)))))
    tree, home = Tree.fit(x, depth)
    members = np.argsort(home, kind="stable")
    leaves = np.arange(1 << depth)
    c, e = np.searchsorted(home[members], leaves), np.searchsorted(home[members], leaves, side="right")
    out: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(q), ATONCE):
        qq, cc = q[start : start + ATONCE], cq[start : start + ATONCE]
        who, leaf = tree.leaves(qq, reach[start : start + ATONCE])
        order = np.argsort(leaf, kind="stable")
        who, leaf = who[order], leaf[order]
        a, b = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, side="right")
        best = np.full((len(qq), k), np.nextafter(np.float32(least), np.float32(-9)), np.float32)
        row = np.full((len(qq), k), -1, np.int64)
        for i in leaves:
            rows, qs = members[c[i] : e[i]], who[a[i] : b[i]]
            if not len(rows) or not len(qs):
                continue
            cos = qq[qs] @ x[rows].T
            new = np.flatnonzero(cos.max(axis=1) > best[qs].min(axis=1))
            if not len(new):
                continue
            qs, cos = qs[new], cos[new]
            cos[cc[qs][:, None] == cx[rows][None, :]] = -9
            both = np.concatenate([best[qs], cos], axis=1)
            names = np.concatenate([row[qs], np.broadcast_to(rows, cos.shape)], axis=1)
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            best[qs], row[qs] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        s, t = np.nonzero(row >= 0)
        out.append((s + start, row[s, t], best[s, t]))
    return tuple(np.concatenate(z) for z in zip(*out))


def neighbours(df: DataFrame, k: int = 10, least: float = -1.0, relax: float = 0.3, queries: Column | None = None) -> DataFrame:
    """Up to ``k`` most similar others for each vector of the same collection.

    ``df``: collection, key, vector (usable ones; repeated rows of a key, taken to be equal, count once;
    null keys are left out). Returns collection, key, other, cosine, rank; ties go to the lesser key, but at the last place
    any of equal cosines may stand. ``least`` is the least cosine of interest and sets the radius of
    the search; where it is below 0.5 the distance to the (k + 1)th nearest row of the sample bounds the
    radius too, as the kth nearest of all rows can't be farther. ``queries`` picks the rows to search
    for, all by default. Vectors that are the same are neighbours like any others. An empty table
    gives an empty result; a collection of one row has no neighbours. Collections are few: the driver
    fits a tree for each on a sample of at most SAMPLE rows or FIT a shard. Every row is indexed.

    Rows and queries of a shard meet in blocks of bounded size however many they are, so that neither
    a crowd of like vectors nor a large collection makes a large task.
    """
    spark = df.sparkSession
    kind = df.schema["key"].dataType.simpleString()
    asked = queries if queries is not None else F.lit(True)
    named = df.where(F.col("key").isNotNull()).select("collection", "key", asked.alias("asks"), F.xxhash64("key").alias("code"), "vector")

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby("collection", sort=False):
                x = _unit(g.pop("vector"))
                g["unit"] = [u.tobytes() for u in x]
                yield g

    rows = materialize(named.mapInPandas(unit, f"collection string, key {kind}, asks boolean, code long, unit binary"))
    sizes = {r[0]: r[1] for r in rows.groupBy("collection").count().collect()}
    trees: dict[str, tuple[Tree, np.ndarray]] = {}
    for name, n in sizes.items():
        shards = max(0, min(int(np.log2(SHARDS)), int(np.ceil(np.log2(n / SHARD)))))
        most = max(SAMPLE, FIT << shards)
        share = min(1 << 30, int((1 << 30) * 1.2 * most / n))
        some = rows.where((F.col("collection") == name) & (F.pmod("code", F.lit(1 << 30)) < share)).select("code", "unit").limit(most).toPandas()
        some = some.drop_duplicates("code")  # repeated rows of a key would pass for its neighbours
        sample = _stack(some["unit"]) if len(some) else np.zeros((1, 1), np.float32)
        trees[name] = Tree.fit(sample, shards)[0], sample[: SAMPLE if least < 0.5 else 0]
    shared = spark.sparkContext.broadcast(trees)
    radius = np.float32(np.sqrt(max(0.0, 2 - 2 * least)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, g in b.groupby("collection", sort=False):
                x, raw = _stack(g["unit"]), g["unit"].to_numpy()
                tree, sample = shared.value[name]
                own, home = tree.leaves(x, np.zeros(len(x), np.float32))
                home = home[np.argsort(own)]
                yield pd.DataFrame({"collection": name, "key": g["key"].to_numpy(), "code": g["code"].to_numpy(), "shard": home, "reach": None, "unit": raw})
                asks = np.flatnonzero(g["asks"].to_numpy(bool))
                if not len(asks):
                    continue
                r = np.full(len(asks), radius)
                if len(sample) > k:
                    for i in range(0, len(asks), 512):
                        d = distances(x[asks[i : i + 512]], sample)
                        r[i : i + 512] = np.minimum(radius, np.partition(d, k, axis=1)[:, k] + np.float32(1e-6))
                who, leaf = tree.leaves(x[asks], r * np.float32(relax))
                at = asks[who]
                yield pd.DataFrame(
                    {"collection": name, "key": g["key"].to_numpy()[at], "code": g["code"].to_numpy()[at], "shard": leaf, "reach": (r * np.float32(relax))[who], "unit": raw[at]}
                )

    # not stored: placing the rows again is cheaper than keeping a copy of each vector for every shard that it visits
    placed = rows.mapInPandas(place, f"collection string, key {kind}, code long, shard int, reach float, unit binary")
    per = placed.groupBy("collection", "shard").agg(
        F.ceil(F.sum(F.col("reach").isNull().cast("int")) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.sum(F.col("reach").isNotNull().cast("int")) / BLOCK).cast("int").alias("crowds"),
    )
    per = F.broadcast(materialize(per.where("blocks > 0 and crowds > 0")))  # at most SHARDS rows a collection
    by = ["collection", "shard", "block", "crowd"]

    # a row lies in one block and meets every crowd of queries; a query is in one crowd and meets every block
    own = F.col("reach").isNull()

    def to(count: str, one: Column) -> Column:
        return F.explode(F.when(one, F.array(F.pmod("code", F.col(count)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(count) - 1)))

    met = placed.join(per, ["collection", "shard"]).withColumn("block", to("blocks", own)).withColumn("crowd", to("crowds", ~own))

    def search(where: tuple, both: pd.DataFrame) -> pd.DataFrame:
        # repeated rows of a key lie in the same task
        left, right = (both[both["reach"].isna() == side].drop_duplicates("code") for side in (True, False))
        if not len(left) or not len(right):
            return pd.DataFrame({"collection": [], "key": [], "other": [], "cosine": []})
        x, q = _stack(left["unit"]), _stack(right["unit"])
        s, t, v = _search(x, left["code"].to_numpy(), q, right["code"].to_numpy(), right["reach"].to_numpy(np.float32), k, least)
        return pd.DataFrame({"collection": where[0], "key": right["key"].to_numpy()[s], "other": left["key"].to_numpy()[t], "cosine": v.astype(np.float64)})

    found = met.select("key", "code", "unit", "reach", *by).groupBy(*by).applyInPandas(search, f"collection string, key {kind}, other {kind}, cosine double")
    # at most k rows of each block
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "other"))), 1, k)
    return (
        found.groupBy("collection", "key")
        .agg(best.alias("best"))
        .select("collection", "key", F.posexplode("best").alias("rank", "n"))
        .select("collection", "key", F.col("n.other").alias("other"), (-F.col("n.far")).alias("cosine"), (F.col("rank") + 1).alias("rank"))
    )
