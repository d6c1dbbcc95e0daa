"""Text functions as Spark expressions. All keep null for null unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word boundary of ASCII words; the JVM's \b also counts accented letters.
B0, B1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

#: Extensions and the language that they stand for.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust",
    "java": "java", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift",
    "kt": "kotlin", "scala": "scala", "sh": "bash", "sql": "sql", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown",
    "html": "html", "css": "css",
}


def trim_white(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(c) / 4), F.lit(0)).cast("int")


def split_identifier(c: Column) -> Column:
    """Distinct parts of an identifier: itself, its camel, snake and kebab parts, and its lower case."""
    camel = F.split(F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), r"\s+")

    def parts(sep: str) -> Column:
        return F.when(F.instr(c, sep) > 0, F.filter(F.split(c, sep), lambda x: x != "")).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.array(c), F.when(F.size(camel) > 1, camel).otherwise(none), parts("_"), parts("-"), F.array(F.lower(c))))
    return F.when(c.isNotNull(), every)


def content_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def entity_hash(type_: Column, name: Column, summary: Column, content: Column) -> Column:
    """Hash of what an entity is embedded by; nulls count as empty."""
    e = F.lit("")
    return content_hash(F.concat_ws("\n", F.coalesce(type_, e), F.coalesce(name, e), F.coalesce(summary, e), F.coalesce(content, e)))


def slug(c: Column) -> Column:
    """Lower case, with a hyphen for every run of other characters than letters and digits, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters among the letters and digits of a lower-cased name."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2))))
    )


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two names' bigrams; 1 for equal normalised names, 0 if there is none to compare."""
    x, y = bigrams(a), bigrams(b)
    both = F.size(F.array_intersect(x, y))
    same = F.regexp_replace(F.lower(a), "[^a-z0-9]", "") == F.regexp_replace(F.lower(b), "[^a-z0-9]", "")
    all_ = F.size(F.array_union(x, y))
    return F.when(same, 1.0).when(all_ == 0, 0.0).otherwise(both / all_)


def term_hits(text: Column, terms: Column) -> Column:
    """How many of the terms occur in the text, case aside; 0 for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(terms, lambda t: F.instr(low, t) > 0))


def keyword_relevance(text: Column, query: Column) -> Column:
    """Words of the query longer than two characters that the text holds, over all its words."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    hits = term_hits(text, F.filter(words, lambda w: F.length(w) > 2))
    return F.when(F.size(words) == 0, 0.0).otherwise(hits / F.size(words))


def language(path: Column) -> Column:
    """Language that the path's extension stands for, or an empty string."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit(""))


def xml_escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def code_slice(text: Column, start: Column, end: Column, around: int = 0) -> Column:
    """Lines start to end (from 1; 50 lines more than start for a null end) with ``around`` lines before and after."""
    lines = F.split(text, "\n", -1)
    first = F.greatest(F.lit(1), start - around)
    last = F.least(F.size(lines), F.coalesce(end, start + 50) + around)
    return F.when(last >= first, F.array_join(F.slice(lines, first, last - first + 1), "\n")).otherwise("")


def import_lines(text: Column) -> Column:
    """The first block of import lines of a source text; blank lines and comments may lie between them."""
    numbered = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line")))

    def imports(x: Column) -> Column:
        return x["line"].rlike(r"^\s*(import |from |const .*require\()")

    found = F.filter(numbered, imports)
    stop = F.filter(numbered, lambda x: (x["i"] > found[0]["i"]) & x["line"].rlike(r"\S") & ~x["line"].rlike(r"^\s*(import|from|//|/\*|\*|const .*require\()"))
    before = F.when(F.size(stop) > 0, stop[0]["i"]).otherwise(F.lit(2147483647))
    return F.transform(F.filter(found, lambda x: x["i"] < before), lambda x: x["line"])


def path_terms(path: Column) -> Column:
    """Parts of a path worth searching for."""
    return F.filter(F.split(path, "/"), lambda x: (F.length(x) > 2) & ~x.isin("src", "lib", "index", "node_modules"))


def identifiers(text: Column, least: int = 3) -> Column:
    """Distinct identifiers of at least ``least`` characters that are no keywords."""
    found = F.regexp_extract_all(text, F.lit(B0 + "([A-Za-z_][A-Za-z0-9_]*)" + B1), F.lit(1))
    keep = F.filter(found, lambda x: F.length(x) >= least)
    return F.array_except(F.array_distinct(keep), F.array(*[F.lit(k) for k in KEYWORDS]))


#: Words of programming languages that name nothing.
KEYWORDS = (
    "function", "class", "const", "let", "var", "if", "else", "for", "while", "return", "import", "export", "from", "async", "await",
    "try", "catch", "throw", "new", "this", "super", "extends", "implements", "interface", "type", "enum", "public", "private",
    "protected", "static", "readonly", "true", "false", "null", "undefined", "void", "any", "string", "number", "boolean", "object",
    "array", "date", "map", "set", "promise", "error",
)


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))
