"""Queries on parsers and functions. Texts of each format are written from the tables and read again, so that the tables say what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell import providers
from siftwell.functions import code as C
from siftwell.functions import queries as Q
from siftwell.functions import text as T
from siftwell.operators import chunks, documents, resolve
from siftwell.plans.document_queries import _SEC, sections
from siftwell.plans.search_queries import _ENT, ents, r6
from siftwell.runtime import materialize, read
from siftwell.sources import files, parsers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registered(sql: str):
    """Registers a query under its name with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _lines(df: DataFrame, by, order: str, line, head: str | None = None, tail: str | None = None) -> DataFrame:
    """path, content: one text per ``by``, a line for each row."""
    x = df.groupBy(by.alias("path")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda r: r["t"]).alias("t"))
    parts = [F.array(F.lit(head))] * (head is not None) + [F.col("t")] + [F.array(F.lit(tail))] * (tail is not None)
    return x.select("path", F.array_join(F.concat(*parts), "\n").alias("content"))


# --- Formats ------------------------------------------------------------------------------------


@registered("SELECT p_brand || '.csv' AS path, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS row, p_partkey::VARCHAR AS key, p_name || '; \"' || p_type || '\"' AS name, ';' AS delimiter FROM part")
def csv_round_trip(spark, d):
    """Parts written as delimited texts, one per brand, with quoted fields that hold delimiters and quotes."""
    p = read(spark, d, "part")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(';"'), "p_name", F.lit('; ""'), "p_type", F.lit('"""'))
    got = parsers.csv(_lines(p, F.concat("p_brand", F.lit(".csv")), "p_partkey", line, head="key;name"))
    return got.select("path", "row", F.col("values")["key"].alias("key"), F.col("values")["name"].alias("name"), "delimiter")


@registered("SELECT p_brand || '.csv' AS path, count(*) AS n_rows, 'key,name' AS columns, least(count(*), 5)::INT AS n_sample FROM part GROUP BY 1")
def csv_documents(spark, d):
    p = read(spark, d, "part")
    text = _lines(p, F.concat("p_brand", F.lit(".csv")), "p_partkey", F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name"), head="key\tname")
    return parsers.csv_summary(parsers.csv(text)).select("path", "n_rows", F.array_join("columns", ",").alias("columns"), F.size("sample").alias("n_sample"))


_XML = "SELECT n_name || '.xml' AS path, '/suppliers/supplier' AS element_path, (row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) + 1)::INT AS line, s_name || ' & co' AS text, s_suppkey::VARCHAR AS key FROM supplier JOIN nation ON n_nationkey = s_nationkey"


@registered(_XML)
def xml_round_trip(spark, d):
    """Suppliers written as XML, one text per nation."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    line = F.concat(F.lit('<supplier key="'), F.col("s_suppkey").cast("string"), F.lit('">'), T.xml_escape(F.concat("s_name", F.lit(" & co"))), F.lit("</supplier>"))
    got = parsers.xml(_lines(s, F.concat("n_name", F.lit(".xml")), "s_suppkey", line, "<suppliers>", "</suppliers>"))
    return got.where("tag = 'supplier'").select("path", "element_path", "line", "text", F.col("attributes")["key"].alias("key"))


@registered("""SELECT 'pom.xml' AS path, 'maven-pom' AS kind UNION ALL SELECT 'a/App.csproj', 'csproj' UNION ALL SELECT 'web.xml', 'web-xml' UNION ALL SELECT 'x.xsd', 'xsd'
UNION ALL SELECT 'x.wsdl', 'wsdl' UNION ALL SELECT 'x.svg', 'svg' UNION ALL SELECT r_name || '.xml', NULL FROM region""")
def xml_kinds(spark, d):
    own = read(spark, d, "region").select(F.concat("r_name", F.lit(".xml")).alias("path"))
    known = spark.sql("SELECT * FROM VALUES ('pom.xml'), ('a/App.csproj'), ('web.xml'), ('x.xsd'), ('x.wsdl'), ('x.svg') AS t(path)")
    return known.unionByName(own).select("path", parsers.xml_kind(F.col("path"), F.lit("root"), F.lit(None).cast("string")).alias("kind"))


@registered("""SELECT o_orderpriority || '/pom.xml' AS path, 'technology' AS type, 'lib-' || count(*) AS name FROM orders GROUP BY o_orderpriority UNION ALL
SELECT o_orderpriority || '/pom.xml', 'section', unnest(['project', 'dependencies']) FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def xml_document_entities(spark, d):
    """A Maven file for each priority of orders, with one dependency."""
    o = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").cast("string").alias("n"))
    text = F.concat(F.lit("<project>\n<dependencies><dependency><artifactId>lib-"), "n", F.lit("</artifactId></dependency></dependencies></project>"))
    got = parsers.xml(o.select(F.concat("o_orderpriority", F.lit("/pom.xml")).alias("path"), text.alias("content")))
    return parsers.xml_entities(got).select("path", "type", "name")


def _config(spark: SparkSession, d: str, end: str, line, head: str | None = None) -> DataFrame:
    n = read(spark, d, "nation").join(read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    text = _lines(n, F.concat("r_name", F.lit(end)), "n_nationkey", line, head)
    return parsers.config_keys(text).select("path", "key", "kind", "value")


_KEYS = "SELECT r_name || '{0}' AS path, 'k' || n_nationkey AS key, 'variable' AS kind, '\"' || n_name || '\"' AS value FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name || '{0}', 'list', 'component', '[1, 2]' FROM region"


@registered(_KEYS.format(".yaml"))
def yaml_documents(spark, d):
    return _config(spark, d, ".yaml", F.concat(F.lit("k"), F.col("n_nationkey").cast("string"), F.lit(': "'), "n_name", F.lit('"')), "list: [1, 2]")


@registered(_KEYS.format(".toml"))
def toml_documents(spark, d):
    return _config(spark, d, ".toml", F.concat(F.lit("k"), F.col("n_nationkey").cast("string"), F.lit(' = "'), "n_name", F.lit('"')), "list = [1, 2]")


@registered("SELECT r_name || '.json' AS path, NULL::VARCHAR AS key, 'text' AS kind, '{broken ' || r_name AS value FROM region")
def broken_documents(spark, d):
    r = read(spark, d, "region").select(F.concat("r_name", F.lit(".json")).alias("path"), F.concat(F.lit("{broken "), "r_name").alias("content"))
    return parsers.config_keys(r).select("path", "key", "kind", "value")


@registered("SELECT r_name || '.md' AS path, 'title' AS key, '\"' || r_name || '\"' AS value FROM region UNION ALL SELECT r_name || '.md', 'size', r_regionkey::VARCHAR FROM region")
def front_matter(spark, d):
    text = F.concat(F.lit("---\ntitle: "), "r_name", F.lit("\nsize: "), F.col("r_regionkey").cast("string"), F.lit("\n---\n# Text\n"))
    return parsers.front_matter(read(spark, d, "region").select(F.concat("r_name", F.lit(".md")).alias("path"), text.alias("content")))


@registered("""SELECT r_name || '/package.json' AS path, 'technology' AS type, 'n' || n_nationkey AS name, n_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_name || '/package.json', 'task', 'build', 'make ' || r_name FROM region""")
def package_json(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    key = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    deps = n.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct(key, "n_name"))).alias("dependencies"))
    text = F.to_json(F.struct("dependencies", F.create_map(F.lit("build"), F.concat(F.lit("make "), "r_name")).alias("scripts")))
    return parsers.package_json(deps.select(F.concat("r_name", F.lit("/package.json")).alias("path"), text.alias("content")))


@registered("SELECT r_name || '.html' AS path, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1)::INT AS nth, 2 AS level, n_name AS title, 'text of ' || n_name AS content FROM nation JOIN region ON r_regionkey = n_regionkey")
def html_sections(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    line = F.concat(F.lit('<h2 class="x">'), "n_name", F.lit("</h2><p>text of <b>"), "n_name", F.lit("</b></p>"))
    return parsers.html_sections(_lines(n, F.concat("r_name", F.lit(".html")), "n_nationkey", line, "<html><style>h1 {}</style>")).select("path", "nth", "level", "title", "content")


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """A diff for each order: a hunk of one line more and one less for every line of it, and a new file."""
    li = read(spark, d, "lineitem")
    n = F.col("l_linenumber") * 10
    hunk = F.concat(F.lit("@@ -"), n.cast("string"), F.lit(",2 +"), n.cast("string"), F.lit(",2 @@ text\n same\n-old "), F.col("l_partkey").cast("string"), F.lit("\n+new "), F.col("l_suppkey").cast("string"))
    text = _lines(li, F.col("l_orderkey"), "l_linenumber", hunk, "diff --git a/src/a.ts b/src/a.ts\nindex 1..2\n--- a/src/a.ts\n+++ b/src/a.ts", "diff --git a/b.md b/b.md\nnew file mode 100644\n--- /dev/null\n+++ b/b.md\n@@ -0,0 +1 @@\n+first")
    return materialize(text.withColumnRenamed("path", "diff_id"))


_HUNKS = "h AS (SELECT l_orderkey AS diff_id, l_linenumber * 10 AS n, l_partkey, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS hunk FROM lineitem)"


@registered(f"""WITH {_HUNKS} SELECT diff_id, 'src/a.ts' AS new_path, 'modified' AS change, kind, old_line, new_line, content FROM (
  SELECT diff_id, 'context' AS kind, n AS old_line, n AS new_line, 'same' AS content FROM h UNION ALL SELECT diff_id, 'removed', n + 1, NULL, 'old ' || l_partkey FROM h UNION ALL SELECT diff_id, 'added', NULL, n + 1, 'new ' || l_suppkey FROM h)
UNION ALL SELECT DISTINCT diff_id, 'b.md', 'added', 'added', NULL, 1, 'first' FROM h""")
def diff_parse(spark, d):
    x = parsers.diff_lines(_diffs(spark, d))
    return x.select("diff_id", "new_path", "change", "kind", F.col("old_line").cast("int").alias("old_line"), F.col("new_line").cast("int").alias("new_line"), "content")


@registered(f"WITH {_HUNKS} SELECT diff_id, 2::BIGINT AS n_files, count(*) + 1 AS n_added, count(*) AS n_removed FROM h GROUP BY 1")
def diff_totals(spark, d):
    return parsers.diff_totals(parsers.diff_lines(_diffs(spark, d)))


@registered(f"WITH {_HUNKS} SELECT diff_id, 'src/a.ts' AS path, (n + 1)::INT AS start, (n + 1)::INT AS end FROM h GROUP BY ALL UNION ALL SELECT DISTINCT diff_id, 'b.md', 1, 1 FROM h")
def diff_ranges(spark, d):
    x = parsers.changed_ranges(parsers.diff_lines(_diffs(spark, d)))
    return x.select("diff_id", "path", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@registered("""SELECT o_custkey AS diff_id, CASE o_orderstatus WHEN 'F' THEN 'M' WHEN 'P' THEN 'D' ELSE 'D' END AS status, 'f' || o_orderkey AS path FROM orders
UNION ALL SELECT o_custkey, 'A', 'g' || o_orderkey FROM orders WHERE o_orderstatus = 'O'""")
def diff_name_status(spark, d):
    """Finished orders as changes, open ones as renames, others as deletions."""
    o = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("M\tf"), o)).when(F.col("o_orderstatus") == "O", F.concat(F.lit("R100\tf"), o, F.lit("\tg"), o)).otherwise(F.concat(F.lit("D\tf"), o))
    return parsers.name_status(_lines(read(spark, d, "orders"), F.col("o_custkey"), "o_orderkey", line).withColumnRenamed("path", "diff_id"))


def _declared(spark: SparkSession, d: str) -> DataFrame:
    """Classes and functions with plain names."""
    return ents(spark, d).where("type in ('class', 'function')").where(F.col("name").rlike("^[A-Za-z][A-Za-z0-9]*$")).select("id", "type", "name")


_DECL = "dcl AS (SELECT id, type, name FROM ent WHERE type IN ('class', 'function') AND regexp_matches(name, '^[A-Za-z][A-Za-z0-9]*$'))"
#: How each language writes a class with a method, and a function, around a name.
_WRITTEN = {
    "ts": ("export class {} extends Base {{\n  run(a: string): void {{\n    return;\n  }}\n}}\n", "export function {}(a: string): void {{\n}}\n"),
    "py": ("class {}(Base):\n    def run(self, a):\n        pass\n", "def {}(a):\n    return 1\n"),
    "java": ("public class {} extends Base {{\n    public void run(String a) {{\n    }}\n}}\n", None),
    "cs": ("public class {} : Base\n{{\n    public void run(string a)\n    {{\n    }}\n}}\n", None),
    "go": ("type {} struct {{\n}}\n", "func {}(a string) {{\n}}\n"),
    "rs": ("pub struct {} {{\n}}\n", "pub fn {}(a: &str) {{\n}}\n"),
    "cpp": ("class {} {{\n}};\n", "int {}(int a) {{\n  return a;\n}}\n"),
}


def _sources(spark: SparkSession, d: str) -> DataFrame:
    e = _declared(spark, d)
    out = []
    for end, (of_class, of_function) in _WRITTEN.items():
        for kind, pattern in (("class", of_class), ("function", of_function)):
            if pattern:
                a, b = pattern.format("\0").split("\0")
                out.append(e.where(F.col("type") == kind).select(F.concat("id", F.lit(f".{end}")).alias("path"), F.concat(F.lit(a), "name", F.lit(b)).alias("content")))
    files_ = out[0]
    for o in out[1:]:
        files_ = files_.unionByName(o)
    return files_


@registered(f"""WITH {_ENT}, {_DECL}, l(ending, language, m, f) AS (VALUES ('ts', 'typescript', true, true), ('py', 'python', true, true), ('java', 'java', true, false), ('cs', 'csharp', true, false), ('go', 'go', false, true), ('rs', 'rust', false, true), ('cpp', 'cpp', false, true))
SELECT id || '.' || ending AS path, language, type, name, name AS qualified_name FROM dcl, l WHERE type = 'class' OR f
UNION ALL SELECT id || '.' || ending, language, 'method', 'run', name || '::run' FROM dcl, l WHERE type = 'class' AND m""")
def code_symbols(spark, d):
    """Classes and functions written in seven languages and parsed."""
    return parsers.code(_sources(spark, d)).select("path", "language", "type", "name", "qualified_name")


@registered(f"""WITH {_ENT}, {_DECL}, c AS (SELECT id || '.ts' AS path, type, name FROM dcl)
SELECT path AS source, path || '::' || name AS target, 'CONTAINS' AS relationship FROM c UNION ALL SELECT path || '::' || name, path || '::' || name || '::run', 'CONTAINS' FROM c WHERE type = 'class'
UNION ALL SELECT path || '::' || name, 'Base', 'EXTENDS' FROM c WHERE type = 'class'""")
def code_edges(spark, d):
    return parsers.code_edges(parsers.code(_sources(spark, d).where("path like '%.ts'"))).select("source", "target", "relationship")


@registered(f"WITH {_ENT}, {_DECL} SELECT id || '.py' AS path, 'error' AS type FROM dcl")
def code_parse_errors(spark, d):
    x = _declared(spark, d).select(F.concat("id", F.lit(".py")).alias("path"), F.concat(F.lit("def "), "name", F.lit("(:\n")).alias("content"))
    return parsers.code(x).select("path", "type")


@registered(f"WITH {_ENT} SELECT DISTINCT file_path, regexp_matches(file_path, '(^|/)(tests|docs)/|[.]md$') AS ignored FROM ent WHERE file_path IS NOT NULL")
def ignore_rules(spark, d):
    globs = files.ignore_globs("# rules\ntests/\ndocs/\n*.md\n!keep.md\n")
    return ents(spark, d).where("file_path is not null").select("file_path", files.ignored(F.col("file_path"), globs).alias("ignored")).distinct()


# --- Functions ----------------------------------------------------------------------------------


@registered(f"WITH {_ENT} SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN length(name) <= 12 THEN name ELSE substring(name, 1, 9) || '...' END AS short, replace(replace(replace(replace(replace(summary, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM ent")
def text_forms(spark, d):
    return ents(spark, d).select("id", T.slug(F.col("name")).alias("slug"), T.truncate(F.col("name"), 12).alias("short"), T.xml_escape(F.col("summary")).alias("escaped"))


@registered(f"""WITH {_ENT} SELECT id, array_to_string(list_filter(string_split(file_path, '/'), lambda x: length(x) > 2 AND x NOT IN ('src', 'lib', 'index', 'node_modules')), ' ') AS terms,
NOT starts_with(file_path, '.') AND NOT starts_with(file_path, '/') AS external, starts_with(name, '_') AND NOT regexp_matches(name, '^__.*__$') AS private,
CASE WHEN contains(qualified_name, '::') THEN 'symbol' WHEN regexp_matches(qualified_name, '[.][A-Za-z0-9]+$') THEN 'file' WHEN qualified_name IS NOT NULL THEN 'module' ELSE 'module' END AS node FROM ent""")
def code_names(spark, d):
    e = ents(spark, d)
    return e.select("id", F.array_join(T.path_terms(F.col("file_path")), " ").alias("terms"), C.is_external(F.col("file_path")).alias("external"), C.is_private(F.col("name")).alias("private"), C.node_type(F.col("qualified_name")).alias("node"))


_KW = ", ".join(f"'{k}'" for k in T.KEYWORDS)


@registered(f"""WITH {_ENT} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1), lambda x: length(x) >= 3 AND x NOT IN ({_KW})))), ' ') AS identifiers
FROM ent WHERE content IS NOT NULL AND NOT regexp_matches(content, '[^\\x00-\\x7F]')""")
def code_identifiers(spark, d):
    e = ents(spark, d).where("content is not null").where(~F.col("content").rlike(r"[^\x00-\x7F]"))
    return e.select("id", F.array_join(F.array_sort(T.identifiers(F.col("content"))), " ").alias("identifiers"))


@registered(f"""WITH {_SEC}, s AS (SELECT id, string_split(content, chr(10)) AS l FROM sec WHERE content IS NOT NULL) SELECT id, array_to_string(l[2:3], chr(10)) AS sliced FROM s""")
def code_slices(spark, d):
    """The second and third line of every section."""
    return sections(spark, d).where("content is not null").select("id", T.code_slice(F.col("content"), F.lit(2), F.lit(3)).alias("sliced"))


@registered(f"""WITH {_ENT}, w AS (SELECT id, list_filter(string_split_regex(lower(name || ' cache of'), '\\s+'), lambda x: x <> '') AS w, lower(coalesce(summary, '')) AS s FROM ent WHERE name IS NOT NULL)
SELECT id, round(len(list_filter(w, lambda x: length(x) > 2 AND contains(s, x))) / len(w), 6) AS relevance FROM w""")
def keyword_relevance(spark, d):
    e = ents(spark, d).where("name is not null")
    return e.select("id", r6(T.keyword_relevance(F.col("summary"), F.concat("name", F.lit(" cache of")))).alias("relevance"))


_SYN = ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(Q.synonym_pairs()))


@registered(f"""WITH {_ENT}, syn(w, s, o) AS (VALUES {_SYN}), t AS (SELECT id, unnest(string_split(lower(summary), ' ')) AS w FROM ent WHERE summary IS NOT NULL)
SELECT id, string_agg(DISTINCT s, ' ' ORDER BY s) AS synonyms FROM t JOIN syn USING (w) WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.id = t.id AND u.w = syn.s) GROUP BY id""")
def synonym_expansion(spark, d):
    words = F.array_distinct(F.split(F.lower("summary"), " "))
    x = ents(spark, d).where("summary is not null").select("id", Q.expansions(words).alias("s")).where("size(s) > 0")
    return x.select("id", F.array_join(F.array_sort("s"), " ").alias("synonyms"))


@registered(f"WITH {_ENT} SELECT id, 'show `' || name || '` now' AS text, name AS mention, 5 AS start FROM ent WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$')")
def mention_extraction(spark, d):
    """Names of entities put in backticks in a query, and found again."""
    x = ents(spark, d).where(F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$")).select("id", F.concat(F.lit("show `"), "name", F.lit("` now")).alias("text"))
    return x.select("id", "text", F.explode(Q.mentions(F.col("text"))).alias("m")).select("id", "text", F.col("m.text").alias("mention"), F.col("m.start").alias("start"))


@registered(f"""WITH {_ENT}, n AS (SELECT id, name FROM ent WHERE type = 'class' AND regexp_matches(name, '^[A-Z][A-Za-z0-9]*$'))
SELECT id, 0 AS part, 'where is ' || name AS text, 1.0::DOUBLE AS weight FROM n UNION ALL SELECT id, 1, 'who reads the journal', 1.0 FROM n""")
def query_decomposition(spark, d):
    """Two questions in one, of every class."""
    e = ents(spark, d).where("type = 'class'").where(F.col("name").rlike("^[A-Z][A-Za-z0-9]*$"))
    x = Q.decompose(e.select(F.col("id").alias("query_id"), F.concat(F.lit("where is "), "name", F.lit("? who reads the journal")).alias("text")))
    return x.select(F.col("query_id").alias("id"), "part", "text", "weight")


@registered(f"""WITH {_ENT} SELECT id, 'Map<string, ' || name || '[]>' AS annotation, name AS types FROM ent WHERE type = 'class' AND regexp_matches(name, '^[A-Z][A-Za-z0-9]*$') AND name NOT IN ('List', 'Dict', 'Set', 'Map', 'Array')""")
def type_names(spark, d):
    e = ents(spark, d).where("type = 'class'").where(F.col("name").rlike("^[A-Z][A-Za-z0-9]*$") & ~F.col("name").isin("List", "Dict", "Set", "Map", "Array"))
    x = e.select("id", F.concat(F.lit("Map<string, "), "name", F.lit("[]>")).alias("annotation"))
    return x.select("id", "annotation", F.array_join(C.type_names(F.col("annotation")), " ").alias("types"))


@registered(f"WITH {_ENT} SELECT id, CASE WHEN length(trim(string_split(summary, chr(10))[1])) > 0 THEN trim(string_split(summary, chr(10))[1]) ELSE upper(type[1]) || lower(type[2:]) || ' ' || name END AS description FROM ent WHERE name IS NOT NULL AND NOT contains(type, '-')")
def symbol_descriptions(spark, d):
    e = ents(spark, d).where("name is not null and type not like '%-%'")
    return e.select("id", C.describe(F.col("type"), F.col("name"), F.col("summary"), F.lit(None).cast("string")).alias("description"))


@registered(f"""WITH {_ENT}, t AS (SELECT id, 'import a from "' || name || '"' || chr(10) || chr(10) || '// x' || chr(10) || 'import b' || chr(10) || 'run(' || name || ')' || chr(10) || 'import c' AS t, name FROM ent WHERE type = 'class' AND name IS NOT NULL)
SELECT id, 'import a from "' || name || '"|import b' AS imports FROM t""")
def import_lines(spark, d):
    e = ents(spark, d).where("type = 'class' and name is not null")
    text = F.concat(F.lit('import a from "'), "name", F.lit('"\n\n// x\nimport b\nrun('), "name", F.lit(")\nimport c"))
    return e.select("id", F.array_join(T.import_lines(text), "|").alias("imports"))


# --- Answers of models --------------------------------------------------------------------------


@registered(f"WITH {_ENT} SELECT id, (length(name) % 11)::DOUBLE AS score FROM ent WHERE name IS NOT NULL")
def answer_scores(spark, d):
    """Scores as a model writes them."""
    e = ents(spark, d).where("name is not null")
    return e.select("id", providers.score(F.concat(F.lit("Score: "), (F.length("name") % 11).cast("string"))).cast("double").alias("score"))


@registered(f"WITH {_ENT} SELECT id, name AS overview, 'a|b' AS topics, 'use ' || type AS decision, 'because' AS context FROM ent WHERE name IS NOT NULL")
def answer_sections(spark, d):
    """Summaries and decisions as a model writes them."""
    e = ents(spark, d).where("name is not null")
    said = F.concat(F.lit("OVERVIEW: "), "name", F.lit("\nTOPICS:\n- a\n2. b\nKEY_POINTS: none"))
    decided = F.concat(F.lit("DECISION: use "), "type", F.lit("\nCONTEXT: because\nALTERNATIVES:\n- x"))
    x = e.select("id", providers.summary(said).alias("s"), providers.decisions(decided)[0].alias("d"))
    return x.select("id", F.col("s.overview").alias("overview"), F.array_join("s.topics", "|").alias("topics"), F.col("d.description").alias("decision"), F.col("d.context").alias("context"))


@registered(f"""WITH {_ENT} SELECT id, CASE WHEN type = 'class' THEN false ELSE true END AS retrieve, CASE WHEN type = 'class' THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, name, 1.0::DOUBLE AS sure FROM ent WHERE name IS NOT NULL""")
def answer_json(spark, d):
    """Gate verdicts, some broken, and entities as a model writes them."""
    e = ents(spark, d).where("name is not null")
    g = providers.gate(F.when(F.col("type") == "class", F.lit('Well: {"retrieve": false, "confidence": 0.9}')).otherwise(F.lit("{broken")))
    found = providers.entities(F.concat(F.lit("here: "), F.to_json(F.array(F.struct("name", F.lit("class").alias("type"), F.lit(7.0).alias("confidence"))))))
    return e.select("id", g["retrieve"].alias("retrieve"), g["confidence"].alias("confidence"), found[0]["name"].alias("name"), found[0]["confidence"].alias("sure"))


# --- Documents ----------------------------------------------------------------------------------


@registered(f"""WITH {_ENT}, r AS (SELECT DISTINCT id AS ref, name AS t FROM ent WHERE name IS NOT NULL AND type = 'class' UNION SELECT id, name || 'X' FROM ent WHERE name IS NOT NULL AND type = 'class')
SELECT ref || '|' || t AS ref_id, (SELECT min(id) FROM ent e WHERE e.name = t AND e.type IN ('class', 'interface', 'type')) IS NOT NULL AS resolved FROM r
WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.qualified_name = t OR e.file_path = t OR (e.name = t AND e.type NOT IN ('class', 'interface', 'type')))""")
def document_link_report(spark, d):
    """Class names, and the same with a letter more, as references: resolved or not."""
    e = materialize(ents(spark, d))
    c = e.where("name is not null and type = 'class'")
    t = c.select("id", F.col("name").alias("text")).unionByName(c.select("id", F.concat("name", F.lit("X")).alias("text"))).distinct()
    other = e.where("name is not null and type not in ('class', 'interface', 'type')").select(F.col("name").alias("text"))
    other = other.unionByName(e.select(F.col("qualified_name").alias("text"))).unionByName(e.select(F.col("file_path").alias("text"))).where("text is not null").distinct()
    refs = materialize(t.join(other, "text", "left_anti").select(F.concat_ws("|", "id", "text").alias("ref_id"), "text"))
    return resolve.report(refs, e).select("ref_id", F.col("entity_id").isNotNull().alias("resolved"))


@registered(f"""WITH {_SEC}, t AS (SELECT id AS section_id, 'n' || coalesce(level, 0) AS w FROM sec)
SELECT section_id, 1::BIGINT AS nth, 'requirement' AS kind, 'The parser  read ' || w AS title, 'The parser must read ' || w || ' at once' AS description, 'must' AS priority, 1 AS n_acceptance FROM t
UNION ALL SELECT section_id, 2, 'constraint', 'No restriction on ' || w, 'No restriction on ' || w, NULL, 0 FROM t""")
def requirement_items(spark, d):
    """Sections whose heading speaks of requirements, with two list items each, one with a criterion of acceptance."""
    w = F.concat(F.lit("n"), F.coalesce("level", F.lit(0)).cast("string"))
    text = F.concat(F.lit("Intro\n- The parser must read "), w, F.lit("\n  at once\n  acceptance criteria: it ends\n2. No restriction on "), w)
    x = sections(spark, d).select(F.col("id").alias("section_id"), F.lit("Functional Requirements").alias("title"), text.alias("content"))
    return documents.requirements(x).select("section_id", "nth", "kind", "title", "description", "priority", F.size("acceptance").alias("n_acceptance"))


@registered(f"""WITH {_SEC} SELECT DISTINCT id AS section_id, 'reader' AS role, 'see ' || coalesce(level, 0) AS want FROM sec""")
def user_stories(spark, d):
    text = F.concat(F.lit("x\nAs a reader, I want to see "), F.coalesce("level", F.lit(0)).cast("string"), F.lit(" so that I know\n"))
    x = documents.user_stories(sections(spark, d).select(F.col("id").alias("section_id"), text.alias("content")))
    return x.select("section_id", "role", F.regexp_replace("want", "^to ", "").alias("want"))


@registered("SELECT doc_id, md5(text) AS rebuilt, true AS bounded FROM documents WHERE length(text) > 0")
def chunks_rebuild(spark, d):
    """Overlapping chunks of every document, put together again without their overlaps, none over the limit."""
    docs = read(spark, d, "documents")
    c = chunks.chunk(docs, "doc_id", "text").select("doc_id", "chunk_index", "start", "end")
    before = F.coalesce(F.lag("end").over(Window.partitionBy("doc_id").orderBy("chunk_index")), F.lit(0))
    spans = c.withColumn("from", before).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_index", "from", "end"))).alias("s"), F.max(F.col("end") - F.col("start")).alias("most"), F.min(F.col("from") >= F.col("start")).alias("meets")
    )
    x = docs.select("doc_id", "text").join(spans, "doc_id").where("length(text) > 0")
    whole = F.array_join(F.transform("s", lambda r: F.substr("text", r["from"] + 1, r["end"] - r["from"])), "")
    return x.select("doc_id", F.md5(whole).alias("rebuilt"), ((F.col("most") <= chunks.ENTITY) & F.col("meets")).alias("bounded"))
