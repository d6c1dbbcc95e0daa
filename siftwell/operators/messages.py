"""Messages, sessions, summaries and decisions: order, pairs, versions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the language of a decision looks like, in three strengths.
DECISION_PATTERNS = (
    r"we('ll| will| should| decided| agreed| chose)",
    r"let's (go with|use|implement|do|try)",
    r"the (decision|plan|approach|strategy) is",
    r"i('ll| will) (use|implement|go with|choose)",
    r"decided to",
    r"agreed (on|to|that)",
    r"going (to|with)",
    r"settled on",
)
DECISION_PHRASES = ("decided", "decision", "agreed", "will use", "chose", "choosing", "let's go with", "let's use", "settled on", "going with", "the plan is", "the approach is")
DECISION_WORDS = ("decided", "decision", "agreed", "will use", "chose", "choosing")
#: Days that archived sessions are kept, and messages after which a summary is due.
RETENTION_DAYS, SUMMARY_AT = 30, 100


def may_decide(content: Column) -> Column:
    return F.coalesce(content.rlike("(?i)" + "|".join(f"(?:{p})" for p in DECISION_PATTERNS)), F.lit(False))


def has_phrase(content: Column, phrases: tuple[str, ...] = DECISION_PHRASES) -> Column:
    low = F.lower(F.coalesce(content, F.lit("")))
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.instr(low, p) > 0)


def _order(desc: bool = False) -> list[Column]:
    cols = [F.col("created_at"), F.col("position"), F.col("id")]
    return [c.desc_nulls_last() for c in cols] if desc else [c.asc_nulls_first() for c in cols]


def recent(messages: DataFrame, k: int, by: str = "session_id") -> DataFrame:
    """The latest ``k`` messages of each session, numbered from the oldest of them."""
    w = Window.partitionBy(by)
    x = messages.withColumn("_n", F.row_number().over(w.orderBy(*_order(desc=True)))).where(F.col("_n") <= k)
    return x.withColumn("nth", F.max("_n").over(w) - F.col("_n") + 1).drop("_n")


def query(messages: DataFrame, role: str | None = None, after=None, before=None, session: str | None = None) -> DataFrame:
    x = messages
    for on, c in ((role, F.col("role") == role), (after, F.col("created_at") > F.lit(after)), (before, F.col("created_at") < F.lit(before)), (session, F.col("session_id") == session)):
        x = x if on is None else x.where(c)
    return x


def pairs(messages: DataFrame, last: int | None = None) -> DataFrame:
    """session_id, pair, question, answer: a user's message that an assistant's follows at once."""
    w = Window.partitionBy("session_id").orderBy(*_order())
    x = messages.withColumn("_r", F.lead("role").over(w)).withColumn("answer", F.lead("content").over(w)).withColumn("_n", F.row_number().over(w))
    x = x.where("role = 'user' and _r = 'assistant'").select("session_id", F.col("_n").alias("pair"), F.col("content").alias("question"), "answer", "id")
    if last is not None:
        x = x.withColumn("_d", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("pair").desc()))).where(F.col("_d") <= last).drop("_d")
    return x


def transcript(messages: DataFrame, longest: int | None = None) -> DataFrame:
    """session_id, transcript: ``role: content`` of every message in order; cut at ``longest`` characters if given."""
    row = F.struct(F.col("created_at").alias("a"), F.col("position").alias("p"), "id", F.concat_ws(": ", "role", F.coalesce("content", F.lit(""))).alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["t"]), "\n\n")
    return messages.groupBy("session_id").agg((text if longest is None else F.substring(text, 1, longest)).alias("transcript"))


def template_summary(messages: DataFrame) -> DataFrame:
    """session_id, n_user, n_assistant and the beginnings (80 characters) of the first five messages."""
    w = Window.partitionBy("session_id").orderBy(*_order())
    x = messages.withColumn("_n", F.row_number().over(w))
    head = F.struct("_n", F.substring(F.coalesce("content", F.lit("")), 1, 80).alias("t"))
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= 5, head))), lambda h: h["t"]), "; ")
    return x.groupBy("session_id").agg(
        F.sum((F.col("role") == "user").cast("int")).alias("n_user"), F.sum((F.col("role") == "assistant").cast("int")).alias("n_assistant"), first.alias("beginnings")
    )


def since_summary(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Messages after the last one that the latest summary (session_id, version, message_range_end) of their session covers."""
    last = summaries.groupBy("session_id").agg(F.max_by("message_range_end", "version").alias("_id"))
    end = messages.join(last, "session_id").where("id = _id").select("session_id", F.col("position").alias("_p"))
    return messages.join(end, "session_id", "left").where("_p is null or position > _p").drop("_p")


def latest_version(summaries: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.col("version").desc(), "id")
    return summaries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def current_session(sessions: DataFrame, by: str | None = None) -> DataFrame:
    """The active session that was updated last."""
    x = sessions.where("status = 'active'")
    return x.groupBy(*([by] if by else [])).agg(F.max_by("id", F.struct("updated_at", "id")).alias("session_id"))


def expired(sessions: DataFrame, now, days: int = RETENTION_DAYS) -> DataFrame:
    """Archived and summarised sessions older than ``days``."""
    return sessions.where(F.col("status").isin("archived", "summarized") & (F.col("archived_at") < F.lit(now) - F.expr(f"interval {days} days")))


def archive(sessions: DataFrame, ids: DataFrame, now, status: str = "archived") -> DataFrame:
    """Sets status, archived_at and updated_at of the sessions in ``ids`` (id)."""
    x = sessions.join(ids.select("id", F.lit(True).alias("_h")).distinct(), "id", "left")
    for c, v in (("status", F.lit(status)), ("archived_at", F.lit(now)), ("updated_at", F.lit(now))):
        x = x.withColumn(c, F.when(F.col("_h"), v).otherwise(F.col(c)))
    return x.select(*sessions.columns)


def due_for_summary(messages: DataFrame, at: int = SUMMARY_AT) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("n_messages")).where(F.col("n_messages") >= at)


def supersede(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """Marks decisions as superseded; ``changes``: id, by."""
    x = decisions.join(changes.select("id", "by"), "id", "left")
    return x.withColumn("status", F.when(F.col("by").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.coalesce("by", "superseded_by")).select(*decisions.columns)


def decisions_of_entity(decisions: DataFrame, entity: str) -> DataFrame:
    return decisions.where(F.array_contains("related_entity_ids", entity)).orderBy(F.col("created_at").desc(), "id")


def search_decisions(decisions: DataFrame, messages: DataFrame, query_text: str, limit: int) -> DataFrame:
    """id, tier, text: decisions that hold the phrase in their description (1) or context (2), then messages that hold it and speak of a decision (3)."""
    p = query_text.lower()

    def holds(c: str) -> Column:
        return F.coalesce(F.instr(F.lower(c), p) > 0, F.lit(False))

    tier = F.when(holds("description"), 1).when(holds("context"), 2)
    d = decisions.select("id", tier.alias("tier"), F.col("description").alias("text"), "created_at").where("tier is not null")
    m = messages.where(holds("content") & has_phrase(F.col("content"), DECISION_WORDS)).select("id", F.lit(3).alias("tier"), F.col("content").alias("text"), "created_at")
    return d.unionByName(m).orderBy("tier", F.col("created_at").desc(), "id").limit(limit)
