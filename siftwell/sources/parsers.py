"""Parsers of document formats. Each maps a table of (path, content) to rows; what cannot be parsed gives no rows or an error column.

Markdown, CSV, XML, configuration files and source code need a parser's state and go through
Arrow batches. HTML and diffs are parsed by Spark expressions alone.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import slug


def _rows(df: DataFrame, parse: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    names = ["path", *[f.split()[0] for f in re.split(r",\s*(?![^<]*>)", schema)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *row) for p, t in zip(b["path"], b["content"]) for row in parse(p, t)], columns=names, dtype=object)

    return df.where(F.col("content").isNotNull() & F.col("path").isNotNull()).select("path", "content").mapInPandas(run, f"path string, {schema}")


# --- Markdown -----------------------------------------------------------------------------------

_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_LINK = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")


def markdown_sections(path: str, text: str) -> Iterator[tuple]:
    """Sections of a Markdown text with their fenced code and links."""
    lines = text.split("\n")
    first = 0
    if lines[0] == "---" and "---" in lines[1:]:
        first = lines.index("---", 1) + 1
    fences = [i for i in range(first, len(lines)) if lines[i].startswith("```")]
    fenced: dict[int, int] = {}  # line -> the line where its block begins
    for a, e in zip(fences[::2], [*fences[1::2], len(lines)][: len(fences[::2])]):
        fenced.update(dict.fromkeys(range(a, min(e + 1, len(lines))), a))
    blocks = list(zip(fences[::2], fences[1::2]))  # a block that is not closed is none
    heads = [(i, m) for i in range(first, len(lines)) if i not in fenced and (m := _HEADING.fullmatch(lines[i]))]
    marks = [i for i, _ in heads] + [len(lines)]
    stack: list[tuple[int, str]] = []
    before = "\n".join(lines[i] for i in range(first, marks[0]) if i not in fenced and lines[i].strip()).strip()
    if heads and before:
        yield ("preamble", "Preamble", 0, before, [], [], None, first + 1, marks[0])
    for (at, m), end in zip(heads, marks[1:]):
        level, title = len(m[1]), m[2]
        while stack and stack[-1][0] >= level:
            stack.pop()
        id_ = re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", title.lower())) or f"section-{at + 1}"
        own = [lines[i] for i in range(at + 1, end) if i not in fenced]
        code = [{"language": lines[a][3:].strip() or None, "code": "\n".join(lines[a + 1 : e]), "start_line": a + 1, "end_line": e + 1} for a, e in blocks if at < a < end]
        links = [{"text": t, "url": u, "is_internal": not u.startswith(("http://", "https://"))} for line in own for t, u in _LINK.findall(line)]
        yield (id_, title, level, "".join(line + "\n" for line in own), code, links, stack[-1][1] if stack else None, at + 1, end)
        stack.append((level, id_))


def markdown(df: DataFrame) -> DataFrame:
    return _rows(
        df,
        markdown_sections,
        "section_id string, title string, level int, content string, code_blocks array<struct<language:string,code:string,start_line:int,end_line:int>>, "
        "links array<struct<text:string,url:string,is_internal:boolean>>, parent string, start_line int, end_line int",
    )


def front_matter(df: DataFrame) -> DataFrame:
    """path, key, value of the top-level keys of Markdown front matter."""
    block = F.regexp_extract("content", r"^---\n((?:.*\n)*?)---(?:\n|$)", 1)
    return config_keys(df.select(F.concat("path", F.lit(".yaml")).alias("path"), block.alias("content")).where("content <> ''")).select(
        F.regexp_replace("path", r"\.yaml$", "").alias("path"), "key", "value"
    )


# --- CSV ----------------------------------------------------------------------------------------

DELIMITERS = (",", "\t", ";", "|")


def csv_fields(line: str, delimiter: str) -> list[str]:
    """Fields of one line; quotes may hold delimiters and doubled quotes, white space at the ends goes."""
    d = re.escape(delimiter)
    found = re.findall(rf'((?:[^{d}"]|"(?:[^"]|"")*(?:"|$))*)({d}|$)', line)
    fields = []
    for field, end in found:
        fields.append(re.sub(r'"((?:[^"]|"")*)(?:"|$)', lambda m: m[1].replace('""', '"'), field).strip())
        if not end:
            break
    return fields


def csv_delimiter(text: str) -> str:
    """The delimiter that cuts the first five lines into the same number of fields, the most; a comma if there is none."""
    lines = [x for x in re.split(r"\r?\n", text)[:5] if x.strip()]
    if len(lines) < 2:
        return ","
    widths = {d: {len(csv_fields(x, d)) for x in lines} for d in DELIMITERS}
    return max(DELIMITERS, key=lambda d: (max(widths[d]) if len(widths[d]) == 1 else 0, -DELIMITERS.index(d)))


def csv(df: DataFrame, delimiter: str | None = None) -> DataFrame:
    """path, row, delimiter, values (column -> text) of delimited texts whose first line names the columns. Blank lines are
    no rows; lines are cut before quotes are read. All rows come, whole."""

    def parse(path: str, text: str) -> Iterator[tuple]:
        lines = re.split(r"\r?\n", text)
        if not lines[0].strip():
            return
        d = delimiter or csv_delimiter(text)
        names = csv_fields(lines[0], d)
        for i, line in enumerate((x for x in lines[1:] if x.strip()), 1):
            yield (i, d, dict(zip(names, csv_fields(line.strip(), d))))

    return _rows(df, parse, "row int, delimiter string, values map<string,string>")


def csv_summary(rows: DataFrame) -> DataFrame:
    """path, n_rows, columns and a sample of five rows of parsed delimited texts."""
    return rows.groupBy("path").agg(
        F.count("*").alias("n_rows"), F.min_by(F.map_keys("values"), "row").alias("columns"), F.sort_array(F.collect_list(F.when(F.col("row") <= 5, F.struct("row", F.map_values("values").alias("values"))))).alias("sample")
    )


# --- XML ----------------------------------------------------------------------------------------


def xml_elements(path: str, text: str) -> Iterator[tuple]:
    """Elements of an XML text in order; one row with an error if it is not well-formed."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    out: list[dict] = []
    open_: list[dict] = []

    def start(tag: str, attributes: dict) -> None:
        up = open_[-1] if open_ else None
        if up:
            up["n"] += 1
        open_.append({"tag": tag, "attrs": attributes, "text": [], "path": (up["path"] if up else "") + "/" + tag, "line": parser.CurrentLineNumber, "n": 0})
        out.append(open_[-1])

    def data(s: str) -> None:
        if open_ and s.strip():
            open_[-1]["text"].append(s.strip())

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda tag: open_.pop(), data
    error = None
    try:
        parser.Parse(text, True)
    except expat.ExpatError as e:
        error = str(e)
    for i, x in enumerate(out):
        yield (i, x["tag"], x["path"], x["line"], " ".join(x["text"]), x["attrs"], x["n"], None)
    if error:
        yield (len(out), None, None, None, None, None, None, error)


def xml(df: DataFrame) -> DataFrame:
    return _rows(df, xml_elements, "nth int, tag string, element_path string, line int, text string, attributes map<string,string>, n_children int, error string")


def xml_kind(path: Column, root: Column, namespace: Column) -> Column:
    """Well-known kinds of XML documents; null for others."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ns = F.coalesce(namespace, F.lit(""))
    return (
        F.when((name == "pom.xml") | ((root == "project") & ns.contains("maven")), "maven-pom")
        .when(name.endswith(".csproj") | ((root == "Project") & ns.contains("microsoft")), "csproj")
        .when(name == "web.xml", "web-xml")
        .when(name.endswith(".xsd") | (root == "schema"), "xsd")
        .when(name.endswith(".wsdl") | (root == "definitions"), "wsdl")
        .when(name.endswith(".svg") | (root == "svg"), "svg")
    )


def xml_entities(elements: DataFrame) -> DataFrame:
    """Sections of parsed XML: elements down to the second level with 20 characters of text or children; and Maven dependencies."""
    level = F.size(F.split("element_path", "/")) - 1
    sections = elements.where((level <= 2) & ((F.length("text") >= 20) | (F.col("n_children") > 0))).select("path", F.lit("section").alias("type"), F.col("tag").alias("name"), "text", "line")
    deps = elements.where(F.col("element_path").endswith("/dependency/artifactId")).select("path", F.lit("technology").alias("type"), F.col("text").alias("name"), "text", "line")
    return sections.unionByName(deps)


# --- Configuration files ------------------------------------------------------------------------


def _load(path: str, text: str):
    end = path.rsplit(".", 1)[-1].lower()
    if end == "json":
        return json.loads(text)
    if end == "toml":
        return tomllib.loads(text)
    import yaml

    return yaml.safe_load(text)


def config_keys(df: DataFrame) -> DataFrame:
    """path, key, kind, value of the top-level keys of JSON, TOML and YAML texts: ``component`` for objects, else ``variable``.

    A text that can't be parsed, or holds no object, gives one row of kind ``text``.
    """

    def parse(path: str, text: str) -> Iterator[tuple]:
        try:
            top = _load(path, text)
        except Exception:  # noqa: BLE001 - any fault of the text makes it plain text
            top = None
        if not isinstance(top, dict):
            yield (None, "text", text)
            return
        for k, v in top.items():
            yield (str(k), "component" if isinstance(v, (dict, list)) else "variable", json.dumps(v, default=str))

    return _rows(df, parse, "key string, kind string, value string")


def package_json(df: DataFrame) -> DataFrame:
    """path, type, name, value of a package.json: dependencies as ``technology``, scripts as ``task``. No Python."""
    m = "map<string,string>"
    x = F.from_json("content", f"dependencies {m}, devDependencies {m}, scripts {m}")
    none = F.create_map().cast(m)
    deps = F.map_entries(F.map_concat(F.coalesce(x["dependencies"], none), F.map_filter(F.coalesce(x["devDependencies"], none), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(x["dependencies"], none)), k))))
    tasks = F.map_entries(F.coalesce(x["scripts"], none))

    def rows(entries: Column, kind: str) -> DataFrame:
        return df.select("path", F.lit(kind).alias("type"), F.explode(entries).alias("e")).select("path", "type", F.col("e.key").alias("name"), F.col("e.value").alias("value"))

    return rows(deps, "technology").unionByName(rows(tasks, "task"))


# --- HTML ---------------------------------------------------------------------------------------


def _clean_html(c: Column) -> Column:
    for p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->"):
        c = F.regexp_replace(c, p, "")
    return c


def strip_tags(c: Column) -> Column:
    """Text between tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def html(df: DataFrame) -> DataFrame:
    """path, title (the file's name if there is none), text."""
    title = F.trim(F.regexp_extract("content", r"(?is)<title[^>]*>(.*?)</title>", 1))
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", F.when(title != "", title).otherwise(name).alias("title"), strip_tags(_clean_html(F.col("content"))).alias("text"))


def html_sections(df: DataFrame) -> DataFrame:
    """path, nth, level, title, content: headings with the text up to the next one; the title stands for missing text."""
    heads = F.regexp_extract_all(_clean_html(F.col("content")), F.lit(r"(?is)(<h([1-6])[^>]*>.*?</h\2>(?:(?!<h[1-6][ >/]).)*)"), F.lit(1))
    x = df.select("path", F.posexplode(heads).alias("nth", "h"))
    head = r"(?is)^<h([1-6])[^>]*>(.*?)</h\1>"
    title = F.trim(F.regexp_replace(F.regexp_extract("h", head, 2), "<[^>]+>", ""))
    text = strip_tags(F.regexp_replace("h", head, ""))
    return x.select("path", "nth", F.regexp_extract("h", head, 1).cast("int").alias("level"), title.alias("title"), F.when(text != "", text).otherwise(title).alias("content")).where("title <> ''").withColumn(
        "qualified_name", F.concat_ws("::", "path", slug(F.col("title")))
    )


# --- Diffs --------------------------------------------------------------------------------------


def diff_lines(df: DataFrame) -> DataFrame:
    """diff_id, file_no, old_path, new_path, change, is_binary, hunk, kind, old_line, new_line, content of unified diffs (diff_id, content).

    Line numbers are running counts within a hunk, so that nothing but windows over one diff is needed.
    Files without hunks have one row of nulls.
    """
    w = Window.partitionBy("diff_id").orderBy("pos")
    x = df.where("content is not null").select("diff_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    x = x.withColumn("file_no", F.sum(F.col("line").startswith("diff --git").cast("int")).over(w)).where("file_no > 0")
    f = Window.partitionBy("diff_id", "file_no").orderBy("pos")
    hunk = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@.*$"
    x = x.withColumn("nth", F.row_number().over(f)).withColumn("hunk", F.sum(F.col("line").rlike(hunk).cast("int")).over(f))
    early = F.when(F.col("nth").between(2, 10), F.col("line"))
    head = x.groupBy("diff_id", "file_no").agg(
        F.max(F.when(F.col("nth") == 1, F.col("line"))).alias("h"),
        F.max(early.startswith("new file mode")).alias("new"),
        F.max(early.startswith("deleted file mode")).alias("gone"),
        F.max(early.startswith("rename from")).alias("moved"),
        F.max(early.contains("Binary files")).alias("bin"),
    )
    path = r"^diff --git a/(.+) b/(.+)$"
    head = head.select(
        "diff_id", "file_no",
        F.when(~F.coalesce("new", F.lit(False)), F.regexp_extract("h", path, 1)).alias("old_path"),
        F.when(~F.coalesce("gone", F.lit(False)), F.regexp_extract("h", path, 2)).alias("new_path"),
        F.when(F.col("moved"), "renamed").when(F.col("gone"), "deleted").when(F.col("new"), "added").otherwise("modified").alias("change"),
        F.coalesce("bin", F.lit(False)).alias("is_binary"),
    )
    c = F.substring("line", 1, 1)
    kind = F.when((c == "+") & ~F.col("line").startswith("+++"), "added").when((c == "-") & ~F.col("line").startswith("---"), "removed").when(c == " ", "context")
    body = x.where("hunk > 0").withColumn("kind", kind)
    h = Window.partitionBy("diff_id", "file_no", "hunk").orderBy("pos")
    start = F.first("line").over(h)

    def number(group: int, kinds: tuple[str, ...]) -> Column:
        at = F.regexp_extract(start, hunk, group).cast("int") + F.sum(F.col("kind").isin(*kinds).cast("int")).over(h) - 1
        return F.when(F.col("kind").isin(*kinds), at)

    body = body.withColumn("old_line", number(1, ("removed", "context"))).withColumn("new_line", number(2, ("added", "context"))).where("kind is not null")
    body = body.select("diff_id", "file_no", "hunk", "kind", "old_line", "new_line", F.expr("substring(line, 2)").alias("content"))
    return head.join(body, ["diff_id", "file_no"], "left")


def diff_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("diff_id").agg(
        F.countDistinct("file_no").alias("n_files"), F.sum((F.col("kind") == "added").cast("int")).alias("n_added"), F.sum((F.col("kind") == "removed").cast("int")).alias("n_removed")
    )


def changed_ranges(lines: DataFrame) -> DataFrame:
    """diff_id, path, start, end: merged line ranges that a diff changes, one per hunk before merging."""
    from siftwell.operators.changes import merge_ranges

    at = F.coalesce("new_line", "old_line")
    x = lines.where(F.col("kind").isin("added", "removed")).groupBy("diff_id", F.coalesce("new_path", "old_path").alias("path"), "hunk").agg(F.min(at).alias("start"), F.max(at).alias("end"))
    return merge_ranges(x, ["diff_id", "path"], "start", "end")


def name_status(df: DataFrame) -> DataFrame:
    """diff_id, status, path of name-status listings (diff_id, content); a rename is a deletion and an addition."""
    x = df.select("diff_id", F.explode(F.split("content", "\n")).alias("line")).where("trim(line) <> ''").select("diff_id", F.split("line", "\t").alias("p"))
    s = F.substring(F.col("p")[0], 1, 1)
    pair = F.when((s == "R") & (F.size("p") > 2), F.array(F.struct(F.lit("D").alias("s"), F.col("p")[1].alias("f")), F.struct(F.lit("A").alias("s"), F.col("p")[2].alias("f")))).otherwise(F.array(F.struct(s.alias("s"), F.col("p")[1].alias("f"))))
    return x.select("diff_id", F.explode(pair).alias("x")).select("diff_id", F.col("x.s").alias("status"), F.col("x.f").alias("path"))


# --- Source code --------------------------------------------------------------------------------

#: Patterns of declarations, one tier for all languages without a parser here: (languages, type, pattern with the name).
_DECLARATIONS = (
    ("typescript javascript", "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("typescript", "interface", r"^\s*(?:export\s+)?interface\s+(\w+)"),
    ("typescript", "type", r"^\s*(?:export\s+)?type\s+(\w+)(?:<[^=]*>)?\s*="),
    ("typescript", "enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
    ("typescript javascript", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("typescript javascript", "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
    ("typescript javascript", "method", r"^\s+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|return\b|catch\b|function\b)(\w+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{]+)?\{"),
    ("go", "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    ("go", "class", r"^type\s+(\w+)\s+(?:struct|interface)\b"),
    ("rust", "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
    ("rust", "class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"),
    ("java csharp", "class", r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial)\s+)*(?:class|record|struct)\s+(\w+)"),
    ("java csharp", "interface", r"^\s*(?:(?:public|private|protected|internal)\s+)*interface\s+(\w+)"),
    ("java csharp", "enum", r"^\s*(?:(?:public|private|protected|internal)\s+)*enum\s+(\w+)"),
    ("csharp", "module", r"^\s*namespace\s+([\w.]+)"),
    ("java csharp", "method", r"^\s*(?:(?:public|private|protected|internal|static|final|async|override|virtual|abstract)\s+)+[\w<>\[\],?.]+\s+(\w+)\s*\("),
    ("c cpp", "class", r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(\w+)\s*(?:final\s*)?(?::[^{;]*)?\{?$"),
    ("c cpp", "enum", r"^\s*enum\s+(?:class\s+)?(\w+)"),
    ("cpp", "module", r"^\s*namespace\s+(\w+)"),
    ("c cpp", "type", r"^\s*(?:typedef\b.*\b(\w+)\s*;|using\s+(\w+)\s*=)"),
    ("c cpp", "function", r"^(?!\s*(?:if|for|while|switch|return|else)\b)[\w:<>*&~\s]+?[\s*&](\w+)\s*\([^;]*\)\s*(?:const\s*)?\{"),
)
_IMPORTS = {
    "typescript": r"""import\s+(?:[\w*{}\s,$]+\s+from\s+)?['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)""",
    "go": r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$',
    "rust": r"(?m)^\s*use\s+([\w:]+)",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",
    "csharp": r"(?m)^\s*using\s+([\w.]+)\s*;",
    "c": r'(?m)^\s*#include\s*[<"]([^>"]+)[>"]',
}
_IMPORTS |= {"javascript": _IMPORTS["typescript"], "cpp": _IMPORTS["c"]}


def _end(lines: list[str], start: int) -> int:
    """Line of the brace that closes the first one opened from ``start`` on, or ``start`` if none is opened within three lines."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened = opened or "{" in lines[i]
        if opened and depth <= 0:
            return i
        if not opened and (i > start + 2 or ";" in lines[i]):
            return start
    return len(lines) - 1


def _python(text: str) -> Iterator[tuple]:
    tree = ast.parse(text)

    def walk(node: ast.AST, owner: str | None) -> Iterator[tuple]:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                kind = "class" if is_class else "method" if owner else "function"
                name = f"{owner}::{n.name}" if owner else n.name
                refs = [ast.unparse(b) for b in n.bases] if is_class else []
                sig = None if is_class else f"({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                yield (kind, n.name, name, owner, n.lineno, n.end_lineno, sig, (ast.get_docstring(n) or "").split("\n")[0] or None, refs, None)
                if is_class:
                    yield from walk(n, name)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                names = [n.module or "."] if isinstance(n, ast.ImportFrom) else [a.name for a in n.names]
                for m in names:
                    yield ("import", m, m, owner, n.lineno, n.end_lineno, None, None, [], None)
            elif not isinstance(n, ast.expr):
                yield from walk(n, owner)

    yield from walk(tree, None)


def code_symbols(language: str, text: str) -> Iterator[tuple]:
    """Declarations and imports of a source text: type, name, qualified name, parent, lines, signature, doc, what it extends, error."""
    if language == "python":
        try:
            yield from _python(text)
        except (SyntaxError, ValueError, RecursionError) as e:
            yield ("error", None, None, None, getattr(e, "lineno", None), None, None, None, [], str(e))
        return
    lines = text.split("\n")
    open_: list[tuple[int, str]] = []
    rules = [(kind, re.compile(p)) for langs, kind, p in _DECLARATIONS if language in langs.split()]
    for i, line in enumerate(lines):
        open_ = [(e, n) for e, n in open_ if e >= i]
        for kind, p in rules:
            m = p.match(line)
            if not m:
                continue
            name, end = next(g for g in m.groups() if g), _end(lines, i)
            owner = open_[-1][1] if open_ else None
            if kind == "method" and not owner:
                continue
            bases = re.findall(r"(?:\bextends|\bimplements|:)\s+([\w.<>, ]+?)\s*(?=\bimplements\b|\{|$)", line) if kind in ("class", "interface") else []
            refs = [re.sub("<.*|^(?:public|private|protected) ", "", b.strip()).strip() for group in bases for b in group.split(",") if b.strip()]
            q = f"{owner}::{name}" if owner else name
            yield (kind, name, q, owner, i + 1, end + 1, line.strip().rstrip("{").strip(), None, refs, None)
            if kind in ("class", "interface", "module"):
                open_.append((end, q))
            break
    for m in re.finditer(_IMPORTS.get(language, r"(?!)"), text):
        name = next(g for g in m.groups() if g)
        at = text.count("\n", 0, m.start()) + 1
        yield ("import", name, name, None, at, at, None, None, [], None)


def code(df: DataFrame) -> DataFrame:
    """Symbols of source files (path, content); the language is that of the extension, others give no rows."""
    from siftwell.sources.files import SOURCE_LANGUAGES

    def parse(path: str, text: str) -> Iterator[tuple]:
        language = SOURCE_LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
        for row in code_symbols(language, text) if language else ():
            yield (language, *row)

    return _rows(
        df, parse, "language string, type string, name string, qualified_name string, parent string, start_line int, end_line int, signature string, doc string, extends array<string>, error string"
    )


def code_edges(symbols: DataFrame) -> DataFrame:
    """source, target, relationship, weight: containment, imports and inheritance of parsed symbols, targets as written."""
    own = F.concat_ws("::", "path", "qualified_name")
    real = symbols.where(~F.col("type").isin("import", "error"))
    up = F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat_ws("::", "path", "parent"))
    c = real.select(up.alias("source"), own.alias("target"), F.lit("CONTAINS").alias("relationship"), F.lit(1.0).alias("weight"))
    i = symbols.where("type = 'import'").select(F.col("path").alias("source"), F.col("name").alias("target"), F.lit("IMPORTS").alias("relationship"), F.lit(1.0).alias("weight"))
    e = real.select(own.alias("source"), F.explode("extends").alias("target"), F.lit("EXTENDS").alias("relationship"), F.lit(1.0).alias("weight"))
    return c.unionByName(i).unionByName(e).distinct()
