"""Graph operators on edge tables: id, source_id, target_id, relationship, weight.

Traversals of a graph of up to ``SMALL`` ways carry it, as numbers, to every task and walk it there, the starts being
spread over the tasks; what a start reaches leaves the task as lists, of which the JVM makes rows. Larger graphs advance a frontier by one join per hop, for all start nodes of a batch at once, and
write each hop to the shared folder; a hub's edges are split by the adaptive skew join, as the
frontier has one row per node and start. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.runtime import materialize, partitions

#: Ways (edges, or twice the edges where they are walked both ways) and bytes of names of nodes up to which a graph is
#: broadcast: a task then holds at most some 250 MB of it, 4 bytes a way, 8 a node, and the names.
SMALL, NAMES = 8_000_000, 96_000_000

#: Ways looked at, and nodes sent, at once.
PIECE, LIST = 1 << 18, 4096

#: Nodes that a task which lists reached nodes is about (Parquet's dictionary, of a megabyte, holds as many ids), nodes that come
#: again and again for one start after the other, the least and most rows of such a task, and sets of nodes to look for.
WIDTH, TURN, ROWS, SETS = 1 << 15, 256, (1 << 21, 1 << 24), 16


def clean(edges: DataFrame, types: list[str] | None = None, min_weight: float | None = None) -> DataFrame:
    """Edges with both ends, each id once, of the given types, and at least ``min_weight`` (a null weight counts as 1)."""
    e = edges.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).dropDuplicates(["id"])
    e = e.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    e = e if types is None else e.where(F.col("relationship").isin(types))
    return e if min_weight is None else e.where(F.col("weight") >= min_weight)


def steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """id, a, b, weight: every way an edge can be walked."""
    out = edges.select("id", F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight")
    back = edges.select("id", F.col("target_id").alias("a"), F.col("source_id").alias("b"), "weight")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


class Ways:
    """A small graph as arrays: the ways of node i lead to ``to[first[i]:first[i + 1]]``. Nodes are numbered in the order of their names.

    ``a`` and ``b`` are the ends of the ways, by a; the ways of a node are walked as they come.
    """

    def __init__(self, names: pa.Array, a: np.ndarray, b: np.ndarray) -> None:
        self.names, self.to = names, b.astype(np.int32)
        self.first = np.searchsorted(a, np.arange(len(names) + 1))

    def find(self, names: pa.Array) -> np.ndarray:
        """Numbers of nodes, -1 where there is no such node."""
        return numbers(self.names, names)

    def back(self) -> Ways:
        """The same graph with all ways turned round."""
        order = np.argsort(self.to, kind="stable")
        return Ways(self.names, self.to[order], np.repeat(np.arange(len(self.names), dtype=np.int32), np.diff(self.first))[order])

    def reach(self, start: int, without: np.ndarray | None = None) -> np.ndarray:
        """Nodes that can be reached from a start, itself left out, on ways that avoid those of the mask ``without``."""
        return np.concatenate([np.empty(0, np.int32), *(nodes for _, nodes, _ in self.levels(start, without=without))])

    def levels(self, start: int, depth: int | None = None, without: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Hop by hop the nodes met for the first time, and the node that each was met from.

        Nodes of a hop come in the order of their best path, so that the first way that leads to a node is its best.
        """
        seen, place = np.zeros(len(self.names), dtype=bool) if without is None else without.copy(), np.empty(len(self.names), np.int32)
        seen[start] = True
        front, hop = np.array([start]), 0
        while depth is None or hop < depth:
            ends = np.cumsum(self.first[front + 1] - self.first[front])
            met = [self._met(x, seen, place) for x in np.split(front, np.searchsorted(ends, np.arange(PIECE, ends[-1], PIECE)))]
            front, hop = np.concatenate([nodes for nodes, _ in met]), hop + 1
            if not len(front):
                return
            yield hop, front, np.concatenate([by for _, by in met])

    def _met(self, front: np.ndarray, seen: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes not seen yet that ways of these lead to, each once, and the node of the first such way."""
        n = self.first[front + 1] - self.first[front]
        ends = np.cumsum(n)
        at = np.arange(n.sum()) + np.repeat(self.first[front] - ends + n, n)
        to = self.to[at]
        new = np.flatnonzero(~seen[to])
        to = to[new]
        # of equal places the last one written stays, so that they are written backwards
        order = np.arange(len(to), dtype=np.int32)
        place[to[::-1]] = order[::-1]
        once = place[to] == order
        to = to[once]
        seen[to] = True
        return to, front[np.searchsorted(ends, new[once], "right")]


def numbers(names: pa.Array, of: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(of, value_set=names), -1).to_numpy(zero_copy_only=False)


def _small(ways: DataFrame, best_first: bool = False):
    """The graph broadcast, if it is small. Only nodes' names and the numbers of both ends of each way come to the driver."""
    if ways.count() > SMALL:
        return None
    nodes = materialize(ways.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    if (nodes.agg(F.sum(F.octet_length("node"))).first()[0] or 0) > NAMES:
        return None
    names = nodes.toArrow()["node"].combine_chunks()
    names = names.take(pc.sort_indices(names))
    sent = ways.sparkSession.sparkContext.broadcast(names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            yield pa.RecordBatch.from_pydict({c: pa.array(numbers(sent.value, t[c].combine_chunks()), pa.int32()) for c in ("a", "b")})

    ways = ways.orderBy("a", -F.col("weight"), "id").select("a", "b") if best_first else ways
    t = ways.mapInArrow(number, "a int, b int").toArrow()
    a, b = t["a"].to_numpy(), t["b"].to_numpy()
    if best_first:
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
    else:
        both = np.unique(a.astype(np.int64) << 32 | b)
        a, b = both >> 32, both & 0xFFFFFFFF
    return ways.sparkSession.sparkContext.broadcast(Ways(names, a, b))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 500_000) -> Iterator[pa.Table]:
    """Batches put together, as looking up names costs as much for a few as for many."""
    some: list[pa.RecordBatch] = []
    for b in batches:
        some.append(b)
        if sum(len(x) for x in some) >= rows:
            yield pa.Table.from_batches(some)
            some = []
    if some:
        yield pa.Table.from_batches(some)


def _spread(df: DataFrame) -> DataFrame:
    """Starts dealt to the tasks; few rows each, as each is a search of its own."""
    return df.repartition(max(partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism))


def distances(edges: DataFrame, starts: DataFrame, direction: str = "out", depth: int | None = None) -> DataFrame:
    """start, node, depth: every node that can be reached from each start (column node), itself at 0.

    Breadth first; ends when a hop brings nothing new, or after ``depth`` hops.
    """
    ways = materialize(steps(edges, direction).where("a <> b").select("a", "b"))
    first = starts.select(F.col("node").alias("start")).where(F.col("node").isNotNull()).distinct()
    small = _small(ways)
    if small is None:
        return _hops(ways, first, depth)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = small.value
        for t in _gathered(batches):
            start = t["start"].combine_chunks()
            yield _lists(start, np.zeros(len(start)), start, np.ones(len(start), np.int64))
            some, size = [], 0
            for k, i in enumerate(g.find(start)):
                for hop, nodes, _ in g.levels(i, depth) if i >= 0 else ():
                    some += [(k, hop, x) for x in np.split(nodes, range(LIST, len(nodes), LIST))]
                    size += len(nodes)
                    if size >= PIECE:
                        yield listed(g, start, some)
                        some, size = [], 0
            if some:
                yield listed(g, start, some)

    def listed(g: Ways, start: pa.Array, some: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        k, hops, nodes = zip(*some)
        return _lists(start.take(pa.array(k)), np.array(hops), g.names.take(pa.array(np.concatenate(nodes))), np.array([len(x) for x in nodes]))

    found = _spread(first).mapInArrow(walk, "start string, depth int, nodes array<string>")
    return found.select("start", F.explode("nodes").alias("node"), "depth")


def _lists(start: pa.Array, depth: np.ndarray, nodes: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.RecordBatch.from_arrays([start, pa.array(depth.astype(np.int32)), pa.ListArray.from_arrays(ends, nodes)], ["start", "depth", "nodes"])


def _hops(ways: DataFrame, first: DataFrame, depth: int | None) -> DataFrame:
    """``distances`` by one join per hop. What was seen is kept in one table, rewritten every few hops."""
    frontier = materialize(first.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    seen, hop = frontier, 0
    while depth is None or hop < depth:
        hop += 1
        reached = ways.join(frontier.select("start", F.col("node").alias("a")), "a").select("start", F.col("b").alias("node")).distinct()
        frontier = materialize(reached.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % 4 == 0:
            seen = materialize(seen)
    return seen


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 2, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (start, node, depth) within ``depth`` hops, and the edges (start, id) met; edges of nodes at the rim are not fetched."""
    nodes = materialize(distances(edges, starts, direction, depth))
    inner = nodes.where(F.col("depth") < depth).select("start", F.col("node").alias("a"))
    met = steps(edges, direction).join(inner, "a").select("start", "id").distinct()
    return nodes, met


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "out", depth: int | None = None) -> DataFrame:
    """start, node, depth without the starts themselves."""
    return distances(edges, starts, direction, depth).where("start <> node")


def reached(edges: DataFrame, starts: DataFrame, direction: str = "out") -> DataFrame:
    """start, node: every other node that can be reached from each start (column node), as ``reachable`` has them, without the hops.

    The rows are starts by nodes, and many starts reach the same nodes. In a small graph these are found once for all of
    them, and the JVM makes their rows from few nodes and many starts at a time. In this order Parquet stores them as
    repeats of a dictionary; names that come in any order take their whole length in every row.
    """
    ways = materialize(steps(edges, direction).where("a <> b").select("a", "b"))
    first = starts.select(F.col("node").alias("start")).where(F.col("node").isNotNull()).distinct()
    small = _small(ways)
    if small is None:
        return _hops(ways, first, None).where("start <> node").select("start", "node")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            yield pa.RecordBatch.from_pydict({"i": pa.array(small.value.find(t["start"].combine_chunks()), pa.int32())})

    context = edges.sparkSession.sparkContext
    among = np.sort(first.mapInArrow(number, "i int").where("i >= 0").toArrow()["i"].to_numpy())
    sets = shared(small.value, among)
    work = dealt(sets, max(partitions(edges.sparkSession), context.defaultParallelism))
    sent = context.broadcast((sets, work))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, work = sent.value
        for b in batches:
            for k, nodes, of in (work[i] for i in b["id"].to_pylist()):
                lists = products(sets[k][0][nodes], sets[k][1][of]) if nodes else others(small.value, sets[k][0], sets[k][1][of])
                for some in _pieces(lists):
                    yield pa.RecordBatch.from_arrays([_named(small.value.names, x) for x in zip(*some)], ["starts", "nodes"])

    found = edges.sparkSession.range(0, len(work), 1, max(1, len(work))).mapInArrow(rows, "starts array<string>, nodes array<string>")
    return found.select(F.explode("starts").alias("start"), "nodes").select("start", F.explode("nodes").alias("node"))


def shared(g: Ways, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sets of nodes, and the starts that reach all nodes of the set (and maybe others); each start is in one place, the last set is empty.

    A set is what can be reached from one node with many ways to and from it: all that lead there reach the set.
    """
    back = g.back()
    worth = np.diff(g.first) * np.diff(back.first)
    sets = []
    for _ in range(SETS if len(worth) else 0):
        one = int(worth.argmax())
        if not worth[one] or not len(starts):
            break
        down, up = np.zeros((2, len(worth)), dtype=bool)
        down[g.reach(one)] = up[back.reach(one)] = down[one] = up[one] = True
        worth[down & up] = 0
        if up[starts].sum() > 1:
            sets.append((np.flatnonzero(down).astype(np.int32), starts[up[starts]]))
            starts = starts[~up[starts]]
    return [*sets, (np.empty(0, np.int32), starts)]


def dealt(sets: list[tuple[np.ndarray, np.ndarray]], tasks: int) -> list[tuple[int, slice | None, slice]]:
    """Set, nodes and starts of each task; without nodes, it is to look for what the starts reach besides."""
    size = min(ROWS[1], max(ROWS[0], sum(len(nodes) * len(of) for nodes, of in sets) // (4 * tasks)))
    work = []
    for k, (nodes, of) in enumerate(sets):
        work += [(k, None, slice(i, None, tasks)) for i in range(min(tasks, len(of)))]
        for i in range(0, len(nodes), WIDTH):
            most = max(1, size // min(WIDTH, len(nodes) - i))
            work += [(k, slice(i, i + WIDTH), slice(j, j + most)) for j in range(0, len(of), most)]
    return work


def products(nodes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and nodes that all of them reach; no start comes with itself."""
    for turn in np.split(nodes, range(TURN, len(nodes), TURN)):
        own = np.isin(starts, turn)
        for of, itself in zip(*(np.split(x, range(LIST // TURN, len(starts), LIST // TURN)) for x in (starts, own))):
            yield from ((of[i : i + 1], turn[turn != of[i]]) for i in range(len(of))) if itself.any() else [(of, turn)]


def others(g: Ways, nodes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each start, and the nodes besides these that it reaches. All that these lead to is among them."""
    without = np.zeros(len(g.names), dtype=bool)
    without[nodes] = True
    for i in range(len(starts)):
        found = g.reach(int(starts[i]), without)
        yield from ((starts[i : i + 1], x) for x in np.split(found, range(LIST, len(found), LIST)))


def _pieces(lists: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    some, size = [], 0
    for x in lists:
        if not len(x[1]):
            continue
        some.append(x)
        size += len(x[0]) + len(x[1])
        if size >= PIECE // 8:
            yield some
            some, size = [], 0
    if some:
        yield some


def _named(names: pa.Array, lists: tuple[np.ndarray, ...]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
    return pa.ListArray.from_arrays(ends, names.take(pa.array(np.concatenate(lists))))


def dependents(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return reachable(edges, starts, "in", 1)


def dependencies(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return reachable(edges, starts, "out", 1)


#: Relations that make one thing depend on another.
DEPENDS = ["imports", "depends_on", "uses"]


def transitive(edges: DataFrame, starts: DataFrame, direction: str = "out", depth: int | None = None) -> DataFrame:
    """Transitive dependencies (``out``) or dependents (``in``), by hops, over edges that make things depend."""
    return reachable(edges.where(F.lower("relationship").isin(DEPENDS)), starts, direction, depth)


def simple_paths(edges: DataFrame, pairs: DataFrame, longest: int = 5, most: int = 10) -> DataFrame:
    """start, goal, path, edges, weight, length, rank: directed paths without repeated nodes, the shortest ``most`` of each pair.

    Parallel edges make different paths. Ties go to the greater weight, then to the edge ids. Only partial
    paths whose end can still reach the goal in the hops that are left are carried on, and none of a pair that has
    ``most`` paths already, as longer ones can't be among its shortest.
    """
    ways = steps(edges, "out").where("a <> b")
    goals = pairs.select(F.col("goal").alias("node")).distinct()
    back = materialize(distances(edges, goals, "in", longest).select(F.col("start").alias("goal"), F.col("node").alias("b"), F.col("depth").alias("left")))
    grow = pairs.select("start", "goal", F.array("start").alias("path"), F.array().cast("array<string>").alias("edges"), F.lit(0.0).alias("weight"), F.col("start").alias("a"))
    found = []
    for hop in range(1, longest + 1):
        grow = materialize(
            ways.join(grow.withColumnRenamed("weight", "_w"), "a")
            .where(~F.array_contains("path", F.col("b")))
            .join(back, ["goal", "b"])
            .where(F.col("left") <= longest - hop)
            .select(
                "start", "goal", F.concat("path", F.array("b")).alias("path"), F.concat("edges", F.array("id")).alias("edges"),
                (F.col("_w") + F.col("weight")).alias("weight"), F.col("b").alias("a"),
            )
        )
        found.append(grow.where("a = goal"))
        done = reduce(DataFrame.unionByName, found).groupBy("start", "goal").agg(F.count("*").alias("_k")).where(F.col("_k") >= most)
        grow = grow.where("a <> goal").join(materialize(done.drop("_k")), ["start", "goal"], "left_anti")
    order = Window.partitionBy("start", "goal").orderBy(F.size("edges"), F.col("weight").desc(), F.col("edges"))
    paths = reduce(DataFrame.unionByName, found).drop("a")
    return paths.withColumn("length", F.size("edges")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def shortest_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """start, goal, path, length: a directed path of fewest hops for each pair that has one; of several the one whose
    edges are heaviest step by step, then of least ids. A pair of one node has a path of length 0."""
    ways = materialize(steps(edges, "out").where("a <> b"))
    asked = pairs.select("start", "goal").where(F.col("start").isNotNull() & F.col("goal").isNotNull()).distinct()
    small = _small(ways, best_first=True)
    if small is None:
        return _path_hops(ways, asked)

    # each start is searched from once, and its goals, however many, are read as they come
    dealt = asked.repartition(max(partitions(edges.sparkSession), edges.sparkSession.sparkContext.defaultParallelism), "start").sortWithinPartitions("start")
    found = dealt.mapInArrow(lambda batches: paths(small.value, batches), "start string, goal string, path array<string>")
    return found.withColumn("length", F.size("path") - 1)


def paths(g: Ways, pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """start, goal, path for pairs (start, goal) that come by start. A search goes on as far as the goals read so far need it."""
    now = -1
    for t in _gathered(pairs):
        start, goal = t["start"].combine_chunks(), t["goal"].combine_chunks()
        same = start.filter(pc.equal(start, goal))
        yield _paths(same, np.arange(len(same)), np.ones(len(same), np.int64))
        i, j = g.find(start), g.find(goal)
        on = (i >= 0) & (j >= 0) & (i != j)
        i, j = i[on], j[on].astype(np.int32)
        some, sizes, size = [], [], 0
        cuts = np.union1d(np.flatnonzero(np.diff(i)) + 1, np.arange(LIST, len(i), LIST)).astype(int)
        for of in np.split(np.arange(len(i)), cuts) if len(i) else ():
            if i[of[0]] != now:
                now = int(i[of[0]])
                levels, deep, back = g.levels(now), np.full(len(g.names), -1, np.int32), np.empty(len(g.names), np.int32)
            goals = j[of]
            while (deep[goals] < 0).any() and (level := next(levels, None)):
                deep[level[1]], back[level[1]] = level[0], level[2]
            for n in np.unique(deep[goals]):
                way = [goals[deep[goals] == n]]
                for _ in range(n):
                    way.append(back[way[-1]])
                if n > 0:
                    some.append(np.stack(way[::-1], axis=1).ravel())
                    sizes.append(np.full(len(way[0]), n + 1))
                    size += len(some[-1])
            if size >= PIECE:
                yield _paths(g.names, np.concatenate(some), np.concatenate(sizes))
                some, sizes, size = [], [], 0
        if some:
            yield _paths(g.names, np.concatenate(some), np.concatenate(sizes))


def _paths(names: pa.Array, nodes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Paths of so many nodes each, given by their numbers one after the other."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(nodes)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(nodes[ends[:-1]])), names.take(pa.array(nodes[ends[1:] - 1])), path], ["start", "goal", "path"])


def _path_hops(ways: DataFrame, pairs: DataFrame) -> DataFrame:
    """``shortest_path`` by one join per hop: for each node met the best way into it, and the paths by going back.

    A row holds start, node, the node before and its place among the paths of its hop, never a whole path.
    """
    frontier = materialize(pairs.select("start", F.col("start").alias("node")).distinct().select("start", "node", F.lit(None).cast("string").alias("before"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place")))
    seen = frontier
    open_ = materialize(pairs.where("start <> goal"))
    hop = 0
    while True:
        hop += 1
        way = F.struct("place", (-F.col("weight")).alias("w"), "id")
        reached = ways.join(frontier.select("start", F.col("node").alias("a"), "place"), "a").select("start", F.col("b").alias("node"), F.struct(way.alias("k"), F.col("a").alias("before")).alias("x"))
        one = reached.groupBy("start", "node").agg(F.min("x").alias("x")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("start").orderBy("x.k"))
        frontier = materialize(one.select("start", "node", "x.before", F.lit(hop).alias("depth"), rank.cast("long").alias("place")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        open_ = materialize(open_.join(frontier.select("start", F.col("node").alias("goal")), ["start", "goal"], "left_anti"))
        frontier = frontier.join(open_.select("start").distinct(), "start", "left_semi")
        if open_.isEmpty():
            break
    seen = materialize(seen)
    path = pairs.join(seen.select("start", F.col("node").alias("goal"), "before", F.col("depth").alias("length")), ["start", "goal"])
    path = materialize(path.select("start", "goal", F.array("goal").alias("path"), "before", "length"))
    for _ in range(path.agg(F.max("length")).first()[0] or 0):
        step = seen.select("start", F.col("node").alias("before"), F.col("before").alias("_b"))
        on = path.where("before is not null").join(step, ["start", "before"])
        on = on.select("start", "goal", F.concat(F.array("before"), "path").alias("path"), F.col("_b").alias("before"), "length")
        path = materialize(path.where("before is null").unionByName(on))
    return path.select("start", "goal", "path", "length")


def connected(edges: DataFrame, pairs: DataFrame, longest: int = 5) -> DataFrame:
    """start, goal, connected: whether there is a directed path of at most ``longest`` hops either way."""
    nodes = pairs.select(F.explode(F.array("start", "goal")).alias("node"))
    d = materialize(distances(edges, nodes, "out", longest))
    there = d.select("start", F.col("node").alias("goal"), F.lit(True).alias("x"))
    back = d.select(F.col("node").alias("start"), F.col("start").alias("goal"), F.lit(True).alias("y"))
    out = pairs.select("start", "goal").distinct().join(there, ["start", "goal"], "left").join(back, ["start", "goal"], "left")
    return out.select("start", "goal", (F.col("x").isNotNull() | F.col("y").isNotNull()).alias("connected"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out, degree; a self-loop counts in both."""
    ends = edges.select(F.col("source_id").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select(F.col("target_id").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("degree"))


def most_connected(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges).orderBy(F.col("degree").desc(), "node").limit(n)


def average_degree(edges: DataFrame) -> DataFrame:
    """n_edges, n_nodes (that have an edge), average_degree: twice the edges over the nodes, 0 for no edges."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node"))
    n = ends.agg((F.count("*") / 2).cast("long").alias("n_edges"), F.countDistinct("node").alias("n_nodes"))
    return n.withColumn("average_degree", F.when(F.col("n_nodes") > 0, 2 * F.col("n_edges") / F.col("n_nodes")).otherwise(0.0))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship").agg(F.count("*").alias("n_edges"))


def touching(edges: DataFrame) -> DataFrame:
    """node, n_edges: edges that have the node as an end; a self-loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("n_edges"))


def roots_and_leaves(edges: DataFrame, hubs: int = 10) -> DataFrame:
    """node, role: ``root`` (nothing leads to it), ``leaf`` (it leads to nothing), ``hub`` (one of the most connected)."""
    d = degrees(edges)
    hub = d.orderBy(F.col("degree").desc(), "node").limit(hubs).select("node", F.lit("hub").alias("role"))
    return d.where("n_in = 0").select("node", F.lit("root").alias("role")).unionByName(d.where("n_out = 0").select("node", F.lit("leaf").alias("role"))).unionByName(hub)


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """start, goal, node: nodes joined to both by an edge of either direction."""
    n = materialize(steps(edges).where("a <> b").select("a", "b").distinct())
    x = pairs.select("start", "goal").distinct().join(n.toDF("start", "node"), "start")
    return x.join(n.toDF("goal", "node"), ["goal", "node"]).where("node <> start and node <> goal").select("start", "goal", "node")


def of_types(edges: DataFrame, entities: DataFrame, types: list[str]) -> DataFrame:
    """Edges of which both ends are entities of the types."""
    ids = entities.where(F.col("type").isin(types)).select("id").distinct()
    out = edges
    for end in ("source_id", "target_id"):
        out = out.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return out.select(*edges.columns)


def orphan_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which an end is no entity."""
    ids = materialize(entities.select("id", F.lit(True).alias("_k")).distinct())
    s, t = ids.toDF("source_id", "_s"), ids.toDF("target_id", "_t")
    return edges.join(s, "source_id", "left").join(t, "target_id", "left").where("_s is null or _t is null").select(*edges.columns)


def redirect(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges after entities were merged (id, primary_id): ends moved, self-loops that this makes dropped, and one edge
    (of least id) for each source, target and relationship."""
    s = merged.select(F.col("id").alias("source_id"), F.col("primary_id").alias("_s"))
    t = merged.select(F.col("id").alias("target_id"), F.col("primary_id").alias("_t"))
    x = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    moved = x.withColumn("_was", F.col("source_id") == F.col("target_id")).withColumn("source_id", F.coalesce("_s", "source_id")).withColumn("target_id", F.coalesce("_t", "target_id"))
    kept = moved.where((F.col("source_id") != F.col("target_id")) | F.col("_was"))
    one = Window.partitionBy("source_id", "target_id", "relationship").orderBy("id")
    return kept.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*edges.columns)
