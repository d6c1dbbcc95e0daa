"""Understanding of query texts: mentions, keywords, intent, gate, decomposition, weights.

A query table has query_id and text; :func:`parse` adds what retrieval needs. Where order and
offsets of overlapping matches matter the rows go through Arrow batches; the rest are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about what is looked for.
STOP_WORDS = (
    "a", "an", "the", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "about", "and", "or", "but", "nor",
    "so", "yet", "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "they", "them", "this", "that", "these", "those",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "can", "may", "might", "what", "which", "who", "whom", "whose", "there", "here", "when", "where", "then", "than",
    "if", "else", "also", "just", "only", "very", "too", "any", "all", "each", "every", "some", "no", "not",
)

#: Groups of words of like meaning; within a group each stands for every other.
SYNONYMS = (
    "function method func handler callback procedure",
    "method function func procedure",
    "class type interface struct model",
    "interface type class contract",
    "file module source",
    "module file package library",
    "database db sqlite sql persistence storage",
    "storage store persistence cache repository",
    "cache memoize cached store",
    "create make add new generate insert",
    "delete remove destroy drop purge",
    "update modify change edit alter patch",
    "get fetch retrieve read load find",
    "set assign write store save",
    "search find query lookup filter match retrieve",
    "error exception bug issue problem fault",
    "bug error issue defect problem",
    "array list collection",
    "object instance entity record",
    "string text str",
    "number int integer float numeric",
    "test spec assertion mock stub fixture",
    "api endpoint route handler controller",
    "config configuration settings options preferences",
    "index indexer indexing catalog scan",
    "embed embedding vector encode",
    "graph network relationship edge node link",
    "parse parser tokenize lex analyze ast",
    "render display show draw",
    "handle process manage deal",
    "validate verify check ensure",
)

#: Patterns of the lower-cased query, its intent and how sure that is; the surest wins, the first of equals.
INTENTS = (
    (r"^(find|search|locate|where\s+is|look\s+for)\b", "find", 0.9),
    (r"\b(definition\s+of|implementation\s+of)\b", "find", 0.85),
    (r"\bwhere\b.*\b(defined|declared|implemented)\b", "find", 0.85),
    (r"^(explain|describe|what\s+is|what\s+does|what\s+are)\b", "explain", 0.9),
    (r"\bhow\s+does\b.*\bwork\b", "explain", 0.85),
    (r"\bexplain\b", "explain", 0.8),
    (r"^(list|show|enumerate|get\s+all)\b", "list", 0.9),
    (r"\b(all|every)\b.*\b(function|class|method|file)s?\b", "list", 0.8),
    (r"what\s+(are\s+)?(the\s+)?(all\s+)?.*s\?$", "list", 0.7),
    (r"^compare\b", "compare", 0.95),
    (r"\bdifference\s+between\b", "compare", 0.9),
    (r"\bvs\.?\b|\bversus\b", "compare", 0.85),
    (r"\b(compare|contrast|differ)\b", "compare", 0.8),
    (r"^how\s+(do|can|to|should)\b", "how", 0.9),
    (r"\bhow\s+to\b", "how", 0.85),
    (r"\bsteps\s+to\b", "how", 0.8),
    (r"^why\b", "why", 0.9),
    (r"\breason\s+(for|why)\b", "why", 0.85),
    (r"\bwhy\s+(is|does|do|are|was|were)\b", "why", 0.85),
    (r"\b(error|bug|issue|problem|crash|fail|broken)\b", "debug", 0.85),
    (r"\b(debug|fix|solve|troubleshoot)\b", "debug", 0.9),
    (r"\bnot\s+working\b", "debug", 0.85),
    (r"\bthrow(s|ing|n)?\b.*\b(error|exception)\b", "debug", 0.8),
)

#: Fixed values of the retrieval gate.
BASIC = (r"(?i)^what('s| is) \d+\s*[+*/-]\s*\d+", r"^(\d+\s*[+*/-]\s*)+\d+")
GREETING = (r"(?i)^(hi|hello|hey|greetings|good\s*(morning|afternoon|evening))", r"(?i)^(thanks|thank\s*you|ty|thx)")
CONFIRMATIONS = ("yes", "no", "okay", "ok", "sure", "yep", "nope", "yeah", "nah")
GENERAL = (
    r"(?i)what('s| is) the difference between",
    r"(?i)how (do|does) (a |the )?(variable|function|class|method|loop|array|object)",
    r"(?i)what (is|are) (a |the )?(variable|function|class|method|loop|array|object)",
    r"(?i)explain (the concept of|what|how)",
)
GENERAL_WORDS = (
    "javascript", "typescript", "python", "java", "c++", "rust", "go", "variable", "function", "loop", "array", "object", "class",
    "async", "await", "promise", "callback", "rest api", "http", "json", "xml",
)

#: How the parts of a query are joined.
QUESTIONS = (r"\?\s+", r";\s+")
CONJUNCTIONS = (r"\band\b", r"\balso\b", r"\bas well as\b", r"\bplus\b", r"\balong with\b")
SEQUENCES = (r"\bthen\b", r"\bafter\b", r"\bfollowed by\b", r"\bbefore\b")
PART_STOP_WORDS = frozenset(
    "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at "
    "by from it its this that how what where when which who why i me my we our you your they their them".split()
)

_CAMEL = re.compile(r"[A-Z][a-z]+(?:[A-Z][a-z]+)+")
_FINDERS = (
    (re.compile(r"`([^`]+)`"), None, True),
    (re.compile(r"(?:^|[\s(])([./]?(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+)(?:[\s):]|$)"), "file", False),
    (re.compile(r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:[A-Z][a-z]+)+)(?![A-Za-z0-9_])"), "class", False),
    (re.compile(r"(?<![A-Za-z0-9_])([a-z][a-zA-Z0-9]*)\s*\("), "function", False),
)


def jvm(pattern: str) -> str:
    """A pattern with ASCII word boundaries for the JVM."""
    return pattern.replace(r"\b", "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def mention_kind(text: str) -> str:
    """What a name in backticks is likely to be."""
    if "/" in text or "\\" in text or re.search(r"\.[A-Za-z0-9_]{1,5}$", text):
        return "file"
    if _CAMEL.fullmatch(text):
        return "class"
    if re.fullmatch(r"[a-z][a-zA-Z0-9]*", text):
        return "function"
    return "variable" if re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", text) else "code"


def find_mentions(text: str) -> list[tuple[str, str, int]]:
    """Names in a query, as (text, kind, start) in order; what lies inside an earlier kind's match is passed over."""
    taken: list[tuple[int, int]] = []
    out = []
    for pattern, kind, whole in _FINDERS:
        for m in pattern.finditer(text):
            a, e = m.span(0) if whole else m.span(1)
            if any(x <= a and y >= e for x, y in taken):
                continue
            taken.append((a, e))
            out.append((m[1], kind or mention_kind(m[1]), a))
    return sorted(out, key=lambda x: x[2])


def mentions(text: Column) -> Column:
    """array<struct<text, kind, start>> of the names in a query; empty for null."""

    @F.pandas_udf("array<struct<text:string,kind:string,start:int>>")
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else [{"text": a, "kind": k, "start": i} for a, k, i in find_mentions(t)])

    return find(text)


def normalize(c: Column) -> Column:
    """Backticks unwrapped, white space collapsed, closing ``?!.`` dropped."""
    x = F.regexp_replace(F.regexp_replace(c, "`([^`]+)`", "$1"), r"\s+", " ")
    return F.trim(F.regexp_replace(x, r"[?!.]+$", ""))


def keywords(normalized: Column, names: Column) -> Column:
    """Distinct tokens of at least two characters that are neither stop words nor numbers, or that are mentioned names."""
    tokens = F.filter(F.split(F.lower(normalized), r"[\s\-_.,;:!?'\"()\[\]{}]+"), lambda t: F.length(t) >= 2)
    low = F.transform(names, lambda n: F.lower(n))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(tokens, lambda t: F.array_contains(low, t) | (~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$"))))


def synonym_pairs() -> list[tuple[str, str]]:
    """Every word of SYNONYMS with each word that stands for it, in the order in which the groups bring them."""
    out: dict[str, dict[str, None]] = {}
    for group in map(str.split, SYNONYMS):
        for w in group:
            out.setdefault(w, {}).update(dict.fromkeys(x for x in group if x != w))
    return [(w, x) for w, others in out.items() for x in others]


def expansions(words: Column) -> Column:
    """Synonyms of the words that are not among them."""
    table: dict[str, list[str]] = {}
    for w, x in synonym_pairs():
        table.setdefault(w, []).append(x)
    lookup = F.create_map(*[c for w, xs in table.items() for c in (F.lit(w), F.array(*map(F.lit, xs)))])
    none = F.array().cast("array<string>")
    return F.array_except(F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(lookup[w], none)))), words)


def intent(text: Column) -> Column:
    """struct<intent, confidence>: the surest pattern that fits, ``general`` with 0.3 if none does."""
    low = F.lower(text)
    best = F.struct(F.lit("general").alias("intent"), F.lit(0.3).alias("confidence"))
    for pattern, name, weight in sorted(reversed(INTENTS), key=lambda x: x[2]):
        best = F.when(low.rlike(jvm(pattern)), F.struct(F.lit(name).alias("intent"), F.lit(weight).alias("confidence"))).otherwise(best)
    return best


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def is_basic(c: Column) -> Column:
    return any_of(c, BASIC)


def is_greeting(c: Column) -> Column:
    return any_of(F.trim(c), GREETING)


def is_confirmation(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*CONFIRMATIONS)


def is_general(c: Column) -> Column:
    """A question on programming at large, with nothing of the project in it."""
    asks = any_of(c, GENERAL)
    own = c.rlike("(?i)our|my|this|the project|codebase")
    word = F.exists(F.array(*[F.lit(w) for w in GENERAL_WORDS]), lambda w: F.instr(F.lower(c), w) > 0)
    return F.when(asks, ~own).otherwise(word & ~c.rlike("(?i)our|my|this (project|codebase|system)"))


def gate(text: Column, kinds: Column, intent_: Column) -> Column:
    """struct<retrieve, confidence, reason>: whether a query needs retrieval at all."""

    def verdict(yes: bool, confidence: float, reason: str) -> Column:
        return F.struct(F.lit(yes).alias("retrieve"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    named = F.arrays_overlap(kinds, F.array(F.lit("file"), F.lit("function"), F.lit("class")))
    return (
        F.when(named, verdict(True, 0.95, "mention"))
        .when(intent_.isin("find", "list", "debug"), verdict(True, 0.9, "intent"))
        .when(is_basic(text), verdict(False, 0.99, "basic"))
        .when(is_greeting(text), verdict(False, 0.99, "greeting"))
        .when(is_confirmation(text), verdict(False, 0.99, "confirmation"))
        .when(is_general(text), verdict(False, 0.8, "general"))
        .otherwise(verdict(True, 0.5, "default"))
    )


def weights(n_mentions: Column, n_keywords: Column, normalized: Column) -> Column:
    """struct<keyword, semantic, graph>: weights of the strategies for one query."""
    named, few = n_mentions > 0, (n_keywords <= 2) & (n_mentions > 0)
    asks = normalized.rlike("(?i)^(how|what|why|where|when|which)")
    path = normalized.rlike(r"\.(ts|js|py|go|rs|java)$")

    def times(on: Column, x: float) -> Column:
        return F.when(on, x).otherwise(1.0)

    kw = F.lit(0.6) * times(named, 1.5) * times(few, 2.0) * times(asks, 0.7)
    sem = F.lit(1.0) * times(few, 0.5) * times(asks, 1.5)
    return F.struct(
        F.when(path, 3.0).otherwise(kw).alias("keyword"), F.when(path, 0.2).otherwise(sem).alias("semantic"), (F.lit(0.8) * times(named, 1.3)).alias("graph")
    )


def parse(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds normalized, mentions, keywords, expanded, intent, confidence, gate and weights to a query table."""
    q = queries.withColumn("mentions", mentions(F.trim(F.col(text)))).withColumn("normalized", normalize(F.trim(text)))
    q = q.withColumn("keywords", keywords(F.col("normalized"), F.col("mentions.text"))).withColumn("expanded", expansions(F.col("keywords")))
    found = intent(F.trim(text))
    return (
        q.withColumn("intent", found["intent"])
        .withColumn("confidence", found["confidence"])
        .withColumn("gate", gate(F.col(text), F.col("mentions.kind"), F.col("intent")))
        .withColumn("weights", weights(F.size("mentions"), F.size("keywords"), F.col("normalized")))
    )


def variants(parsed: DataFrame) -> DataFrame:
    """query_id, variant, text: the distinct search texts of a parsed query, in order."""
    both = F.concat("keywords", "expanded")
    none = F.array().cast("array<string>")
    texts = F.concat(
        F.array("normalized"),
        F.when(F.size("keywords") > 0, F.array(F.array_join("keywords", " "))).otherwise(none),
        F.when(F.size("expanded") > 0, F.array(F.array_join(both, " "))).otherwise(none),
        F.col("mentions.text"),
    )
    return parsed.select("query_id", F.posexplode(F.array_distinct(texts)).alias("variant", "text"))


def parts(text: str) -> list[tuple[str, float]]:
    """Independent parts of a query with their weights."""
    text = text.strip()

    def cut(pattern: str) -> list[str]:
        return [p.strip() for p in re.split(pattern, text) if len(p.strip()) > 3]

    def words(p: str) -> set[str]:
        return {w for w in re.split(r"[^A-Za-z0-9_]+", p.lower()) if len(w) > 2 and w not in PART_STOP_WORDS}

    def apart(ps: list[str]) -> bool:
        sets = [words(p) for p in ps]
        return all(not min(len(a), len(b)) or len(a & b) / min(len(a), len(b)) <= 0.5 for a, b in zip(sets, sets[1:]))

    for pattern in QUESTIONS:
        if len(found := cut(pattern)) > 1:
            return [(p, 1.0) for p in found]
    for patterns, step in ((CONJUNCTIONS, 0.0), (SEQUENCES, 0.1)):
        for pattern in patterns:
            if len(found := cut("(?ai)" + pattern)) > 1 and apart(found):
                return [(p, 1.0 - step * i) for i, p in enumerate(found)]
    return [(text, 1.0)]


def decompose(queries: DataFrame, text: str = "text") -> DataFrame:
    """query_id, part, text, weight: one row for each independent part of a query; a null query has none."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, i, p, w) for q, t in zip(b["query_id"], b["_t"]) for i, (p, w) in enumerate(parts(t))]
            yield pd.DataFrame(rows, columns=["query_id", "part", "text", "weight"])

    rows = queries.where(F.col(text).isNotNull()).select("query_id", F.col(text).alias("_t"))
    return rows.mapInPandas(run, f"query_id {kind}, part int, text string, weight double")
