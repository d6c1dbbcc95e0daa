"""References, mentions and requirements in document sections; critique of drafts against their context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import B0, B1

#: What a reference to code looks like.
_SUFFIXES = "Service|Controller|Manager|Handler|Provider|Factory|Store|Repository|Component|Module|Util|Helper|Config|Error|Exception|Interface|Type|Enum"
REFERENCE_PATTERNS = {
    "backtick": r"`([^`]+)`",
    "filepath": r"(?:^|[\s(,])((?:\.{1,2}/)?[A-Za-z0-9_/-]+\.(?:ts|tsx|js|jsx|py|go|rs|java|cpp|c|h|rb|php|swift|kt))(?=[\s),.]|$)",
    "classname": B0 + f"([A-Z][a-zA-Z0-9]+(?:{_SUFFIXES}))" + B1,
    "function": B0 + r"([a-z][a-zA-Z0-9_]*)\(\)",
}
#: What a mention of a known entity looks like, and how sure it is.
MENTION_PATTERNS = (
    (r"`([A-Za-z_][A-Za-z0-9_.]*(?:\(\))?)`", 0.95),
    (B0 + "([A-Z][a-z]+(?:[A-Z][a-z]+)+)" + B1, 0.8),
    (B0 + r"((?:src|lib|test|tests)/[A-Za-z0-9_/.-]+\.[A-Za-z0-9_]+)" + B1, 0.9),
)
#: Headings of sections that state requirements, and the words of priorities and kinds.
REQUIREMENT_HEADINGS = (
    "requirements", "features", "user stories", "functional requirements", "non-functional requirements", "specifications", "constraints",
    "goals", "objectives", "acceptance criteria", "use cases",
)
PRIORITIES = (
    ("must", "must|shall|required|mandatory"),
    ("should", "should|recommended|preferably"),
    ("could", "could|may|optional|nice to have"),
    ("wont", "won't|will not|out of scope|not included"),
)
USER_STORY = r"(?i)as an?\s+(.+?),?\s+i want\s+(.+?),?\s+so that\s+(.+)"
ACCEPTANCE = r"(?i)acceptance criteria|given.+when.+then"


def code_references(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ref, kind: references to code in a text, each once by its first kind; names and calls only outside backticks."""
    bare = F.regexp_replace(text, "`([^`]+)`", "")

    def found(kind: str) -> Column:
        src = F.col(text) if kind in ("backtick", "filepath") else bare
        return F.transform(F.regexp_extract_all(src, F.lit(REFERENCE_PATTERNS[kind]), F.lit(1)), lambda r: F.struct(r.alias("ref"), F.lit(kind).alias("kind")))

    x = df.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(*map(found, REFERENCE_PATTERNS))).alias("r")).select(key, "r.*")
    order = F.array_position(F.array(*map(F.lit, REFERENCE_PATTERNS)), F.col("kind"))
    return x.groupBy(key, "ref").agg(F.min_by("kind", order).alias("kind"))


def mentions(df: DataFrame, key: str, text: str, entities: DataFrame) -> DataFrame:
    """key, name, confidence: mentions of entities that exist, each once by its first pattern."""

    def found(i: int, pattern: str, sure: float) -> Column:
        names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(names, lambda n: F.struct(F.lit(i).alias("o"), F.replace(n, F.lit("()"), F.lit("")).alias("name"), F.lit(sure).alias("c")))

    parts = [found(i, p, c) for i, (p, c) in enumerate(MENTION_PATTERNS)]
    x = df.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(*parts)).alias("m")).select(key, "m.*")
    known = entities.select("name").where("name is not null").distinct()
    return x.join(known, "name", "left_semi").groupBy(key, "name").agg(F.min_by("c", "o").alias("confidence"))


def priority(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(PRIORITIES):
        out = F.when(c.rlike(f"(?i){B0}(?:{words}){B1}"), name).otherwise(out)
    return out


def requirement_kind(c: Column) -> Column:
    return (
        F.when(c.rlike(USER_STORY), "user-story")
        .when(c.rlike("(?i)constraint|limitation|restriction|must not|cannot"), "constraint")
        .when(c.rlike("(?i)feature|capability|ability to|support for"), "feature")
        .otherwise("requirement")
    )


def requirements(sections: DataFrame) -> DataFrame:
    """id, section_id, nth, kind, title, description, priority, acceptance of list items in sections (section_id, title, content)
    whose heading speaks of requirements.

    An item goes on over the lines that follow; from a line that speaks of acceptance on they are its criteria.
    The id is a hash of section and item, so that it stays the same when it is extracted again.
    """
    heading = F.lower("title").rlike("|".join(REQUIREMENT_HEADINGS))
    x = sections.where(heading & F.col("content").isNotNull()).select("section_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    x = x.withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).where("line <> ''")
    w = Window.partitionBy("section_id").orderBy("pos")
    starts = F.col("line").rlike(r"^(?:[-*]|\d+\.)")
    text = F.when(starts, F.trim(F.regexp_replace("line", r"^[-*\d.]+\s*", ""))).otherwise(F.col("line"))
    x = x.withColumn("nth", F.sum(starts.cast("int")).over(w)).where("nth > 0").withColumn("starts", starts).withColumn("text", text)
    item = Window.partitionBy("section_id", "nth").orderBy("pos")
    x = x.withColumn("acc", F.coalesce(F.max(~F.col("starts") & F.col("line").rlike(ACCEPTANCE)).over(item), F.lit(False)))
    row = F.struct("pos", "text")

    def texts(on: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(on, row))), lambda r: r["text"])

    first = F.max(F.when(F.col("starts"), F.col("text")))
    g = x.groupBy("section_id", "nth").agg(first.alias("first"), texts(~F.col("acc")).alias("d"), texts(F.col("acc")).alias("acceptance")).where("first <> ''")
    title = F.trim(F.regexp_replace("first", f"(?i){B0}(?:must|shall|should|could|may|required|mandatory|optional){B1}", ""))
    short = F.when(F.length(title) > 80, F.concat(F.substring(title, 1, 77), F.lit("..."))).otherwise(title)
    return g.select(
        F.substring(F.sha2(F.concat_ws("|", "section_id", F.col("nth").cast("string"), "first"), 256), 1, 16).alias("id"), "section_id", "nth",
        requirement_kind(F.col("first")).alias("kind"), F.when(short == "", "Untitled Requirement").otherwise(short).alias("title"),
        F.array_join("d", " ").alias("description"), priority(F.col("first")).alias("priority"), "acceptance",
    )


def user_stories(sections: DataFrame) -> DataFrame:
    """section_id, story, role, want, benefit of user stories anywhere in a section's text, each of one line."""
    x = sections.where(F.col("content").isNotNull()).select("section_id", F.explode(F.regexp_extract_all("content", F.lit(f"({USER_STORY})"), F.lit(1))).alias("story"))
    part = [F.trim(F.regexp_extract("story", USER_STORY, i)).alias(n) for i, n in ((1, "role"), (2, "want"), (3, "benefit"))]
    return x.select("section_id", F.trim("story").alias("story"), *part).distinct()


#: How a draft admits that it does not know, speaks its mind, speaks of code, and claims too much.
UNSURE = r"(?i)i (don't|do not) (know|have|see)|i('m| am) (not sure|uncertain|unsure)|no information (available|found)"
OPINION = r"(?i)^i (think|believe|suggest|recommend)|^(in my opinion|personally)|^(you could|you might|consider)|(would be better|might be helpful)"
CODE_CLAIM = r"(?i)`[^`]+`|function\s+[a-z0-9_]+|class\s+[a-z0-9_]+|the\s+[a-z0-9_]+\s+(method|function|class|file)|[a-z0-9_]+\.(ts|js|py|go|rs|java)$"
STRONG = (("percentage", B0 + r"\d+%"), ("absolute", r"(?i)always|never|must|guaranteed"), ("exclusive", r"(?i)the only (way|method|approach)"))


def supported(claim: Column, names: Column, context: Column) -> Column:
    """Whether a claim names a source, or more than half of its longer words are in the context."""
    low, ctx = F.lower(claim), F.lower(context)
    named = F.exists(names, lambda n: F.instr(low, F.lower(n)) > 0)
    words = F.transform(F.filter(F.split(claim, r"\s+"), lambda w: F.length(w) > 4), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    hit = F.size(F.filter(words, lambda w: F.instr(ctx, w) > 0))
    return named | (F.when(F.size(words) > 0, hit / F.size(words)).otherwise(0.0) > 0.5)


def claims(drafts: DataFrame) -> DataFrame:
    """draft_id, nth, claim, kind (opinion, code, factual), supported of the sentences of drafts (draft_id, draft, context, names)."""
    x = drafts.select("draft_id", "context", "names", F.posexplode(F.filter(F.split("draft", "[.!?]+"), lambda s: F.length(F.trim(s)) > 10)).alias("nth", "claim"))
    x = x.withColumn("claim", F.regexp_replace("claim", r"^\s+|\s+$", ""))
    kind = F.when(F.col("claim").rlike(OPINION), "opinion").when(F.col("claim").rlike(CODE_CLAIM), "code").otherwise("factual")
    return x.select("draft_id", "nth", "claim", kind.alias("kind"), ((kind == "opinion") | supported(F.col("claim"), F.col("names"), F.col("context"))).alias("supported"))


def critique(drafts: DataFrame) -> DataFrame:
    """draft_id, issue, severity, detail: what is wrong with a draft. It passes if no severity is ``high``."""
    low_names = F.transform("names", lambda n: F.lower(n))
    ctx = F.lower("context")
    refs = F.array_distinct(F.concat(F.regexp_extract_all("draft", F.lit("`([^`]+)`"), F.lit(1)), F.regexp_extract_all("draft", F.lit(B0 + r"([A-Za-z0-9_-]+\.(?:tsx|ts|jsx|js|py|go|rs|java))" + B1), F.lit(1))))

    def unknown(r: Column) -> Column:
        x = F.lower(r)
        return ~(F.instr(ctx, x) > 0) & ~F.exists(low_names, lambda n: (F.instr(n, x) > 0) | (F.instr(x, n) > 0))

    def issue(kind: str, severity: str, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("issue"), F.lit(severity).alias("severity"), detail.alias("detail"))

    found = [
        F.when(F.length(F.trim("draft")) < 10, F.array(issue("too_short", "high", F.lit(None).cast("string")))),
        F.when((F.size("names") > 0) & F.col("draft").rlike(UNSURE), F.array(issue("unsure", "medium", F.lit(None).cast("string")))),
        F.transform(F.filter(refs, unknown), lambda r: issue("unknown_reference", "medium", r)),
    ]

    def strong(name: str, pattern: str) -> Column:
        # with 50 characters on either side
        around = F.regexp_extract_all("draft", F.lit(f"(?s)(.{{0,50}}(?:{pattern}).{{0,50}})"), F.lit(1))
        return F.transform(F.filter(around, lambda a: ~supported(a, F.col("names"), F.col("context"))), lambda a: issue(f"{name}_claim", "low", a))

    found += [strong(name, p) for name, p in STRONG]
    none = F.array().cast("array<struct<issue:string,severity:string,detail:string>>")
    return drafts.select("draft_id", F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("i")).select("draft_id", "i.*")


#: Kinds of proactive suggestions: types, least score (exclusive), most of them.
SUGGESTIONS = (("decision", ("decision",), 0.6, 5), ("change", ("file", "function", "class"), 0.5, 3), ("doc", ("document", "section"), 0.65, 3), ("related_code", ("function", "class", "method"), 0.5, 3))


def suggestions(related: DataFrame, least: float = 0.5, most: int = 5) -> DataFrame:
    """query_id, entity_id, kind, score, rank of related entities (query_id, entity_id, type, score, updated_at): the best of each
    kind, each entity once by its first kind, and of these the best ``most``."""
    parts = []
    for i, (kind, types, above, n) in enumerate(SUGGESTIONS):
        on = F.col("type").isin(*types) & (F.col("score") > above)
        on = on & F.col("updated_at").isNotNull() if kind == "change" else on
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "entity_id")
        parts.append(related.where(on).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select("query_id", "entity_id", "score", F.lit(kind).alias("kind"), F.lit(i).alias("_k")))
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    one = x.groupBy("query_id", "entity_id").agg(F.min_by("kind", "_k").alias("kind"), F.max("score").alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "entity_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


#: Subscriptions whose patterns are literals of one scan; more of them take more scans.
WATCHED = 500


def subscriptions_due(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """subscription_id, event_id of events (event_id, path, ts) that an enabled subscription (id, patterns, cooldown_ms,
    last_triggered_at) watches and whose cooldown is over. The driver reads the subscriptions, as their patterns become
    literals of scans; none of them gives no rows."""
    from siftwell.sources.files import glob_regex

    subs = subscriptions.where("enabled").select("id", "patterns", "cooldown_ms", F.unix_millis(F.col("last_triggered_at").cast("timestamp")).alias("last")).collect()
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    parts = []
    for i in range(0, max(1, len(subs)), WATCHED):
        hits = []
        for s in subs[i : i + WATCHED]:
            on = F.col("path").rlike("|".join(glob_regex(p) for p in s.patterns)) if s.patterns else F.lit(False)
            if s.last is not None:
                on = on & (at >= s.last + (s.cooldown_ms or 0))
            hits.append(F.when(on, F.lit(s.id)))
        found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
        parts.append(events.select(F.explode(found).alias("subscription_id"), "event_id"))
    return reduce(DataFrame.unionByName, parts)
