"""Hot memory that spills by itself: a state machine per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell.operators.analytics import HOT_TOKENS

#: Items that a spill moves (fixed value).
SPILL = 4
_MOVES = "session_id string, id string, from_tier string, to_tier string"
_STATE = "ids array<string>, tokens array<int>, relevance array<double>, at array<double>, accesses array<int>"


class Hot:
    """Hot items of one session."""

    def __init__(self, items: list[tuple] | None = None, limit: int = HOT_TOKENS) -> None:
        self.items = items or []  # (relevance, at, id, tokens, accesses)
        self.limit = limit

    def add(self, id_: str, tokens: int, relevance: float, at: float, accesses: int) -> list[tuple[str, str, str]]:
        """Add an item; returns moves (id, from, to). If the tokens would go over the limit the least relevant, then
        oldest, items move first: to warm with three accesses or more, else to cold."""
        moves = []
        if sum(i[3] for i in self.items) + tokens > self.limit:
            out = sorted(self.items)[:SPILL]
            self.items = [i for i in self.items if i not in out]
            moves = [(i[2], "hot", "warm" if i[4] >= 3 else "cold") for i in out]
        self.items.append((relevance, at, id_, tokens, accesses))
        return [*moves, (id_, "new", "hot")]


def _ordered(b: pd.DataFrame) -> pd.DataFrame:
    return b.sort_values(["at", "id"])


def auto_spill(items: DataFrame, limit: int = HOT_TOKENS, late: str = "1 hour", idle: int = 24) -> DataFrame:
    """Moves of items (session_id, id, token_count, relevance_score, created_at, access_count) that are added in the order of time.

    On a table every session is replayed by itself (sessions are bounded by what one user says); an id counts once. On a
    stream the hot items are the state, so that it is bounded by the limit; ids that come again within ``late`` are dropped
    before, and a session without items for ``idle`` hours is forgotten.
    """
    x = items.where("session_id is not null and id is not null").select(
        F.col("session_id").cast("string").alias("session_id"), F.col("id").cast("string").alias("id"), F.coalesce("token_count", F.lit(0)).cast("int").alias("tokens"),
        F.coalesce("relevance_score", F.lit(0.0)).cast("double").alias("relevance"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6, F.lit(0.0)).alias("at"),
        F.coalesce("access_count", F.lit(0)).cast("int").alias("accesses"),
    )

    def replay(b: pd.DataFrame) -> pd.DataFrame:
        hot, rows, seen = Hot(limit=limit), [], set()
        for r in _ordered(b).itertuples():
            if r.id not in seen:
                seen.add(r.id)
                rows += [(r.session_id, *m) for m in hot.add(r.id, r.tokens, r.relevance, r.at, r.accesses)]
        return pd.DataFrame(rows, columns=["session_id", "id", "from_tier", "to_tier"])

    if not items.isStreaming:
        return x.groupBy("session_id").applyInPandas(replay, _MOVES)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hot = Hot(limit=limit)
        if state.exists:
            ids, tokens, relevance, at, accesses = state.get
            hot = Hot(list(zip(relevance, at, ids, tokens, accesses)), limit)
        rows = []
        for r in _ordered(pd.concat(list(batches))).itertuples():
            rows += [(key[0], *m) for m in hot.add(r.id, int(r.tokens), float(r.relevance), float(r.at), int(r.accesses))]
        i = hot.items
        state.update(([a[2] for a in i], [a[3] for a in i], [a[0] for a in i], [a[1] for a in i], [a[4] for a in i]))
        latest = max([state.getCurrentWatermarkMs(), *(int(a * 1000) for a in (x[1] for x in i))])
        state.setTimeoutTimestamp(latest + idle * 3_600_000)
        yield pd.DataFrame(rows, columns=["session_id", "id", "from_tier", "to_tier"])

    x = x.withColumn("_t", F.timestamp_seconds("at")).withWatermark("_t", late).dropDuplicatesWithinWatermark(["session_id", "id"])
    return x.groupBy("session_id").applyInPandasWithState(step, _MOVES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
