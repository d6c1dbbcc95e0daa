import pytest
from pyspark.sql import functions as F

from siftwell.functions import code as C
from siftwell.functions import queries as Q
from siftwell.functions import text as T
from siftwell.operators import search
from siftwell.sources import files


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name,parts",
    [
        ("handleUserLogin", ["handleUserLogin", "handle", "User", "Login", "handleuserlogin"]),
        ("XMLParser", ["XMLParser", "XML", "Parser", "xmlparser"]),
        ("snake_case_name", ["snake_case_name", "snake", "case", "name"]),
        ("kebab-case", ["kebab-case", "kebab", "case"]),
        ("plain", ["plain"]),
        (None, None),
    ],
)
def test_split_identifier(spark, name, parts):
    assert one(spark, T.split_identifier(F.col("n")), n=name) == parts


def test_small_text_functions(spark):
    assert one(spark, T.estimate_tokens(F.col("t")), t="abcde") == 2
    assert one(spark, T.estimate_tokens(F.col("t")), t=None) == 0
    assert one(spark, T.slug(F.col("t")), t=" Getting  Started! ") == "getting-started"
    assert one(spark, T.language(F.col("t")), t="a/b.TSX") == "typescript"
    assert one(spark, T.language(F.col("t")), t="Makefile") == ""
    assert one(spark, T.code_slice(F.col("t"), F.lit(2), F.lit(3)), t="a\nb\nc\nd") == "b\nc"
    assert one(spark, T.import_lines(F.col("t")), t="// x\nimport a\n\nfrom b import c\ncode\nimport d") == ["import a", "from b import c"]
    assert one(spark, T.path_terms(F.col("t")), t="src/auth/db/session") == ["auth", "session"]
    assert one(spark, T.xml_escape(F.col("t")), t="<a & 'b'>") == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, T.identifiers(F.col("t")), t="const foo = barBaz(foo, x)") == ["foo", "barBaz"]


def test_name_similarity(spark):
    s = T.name_similarity(F.col("a"), F.col("b"))
    assert one(spark, s, a="UserService", b="user_service") == 1
    assert one(spark, s, a="abc", b="xyz") == 0
    assert one(spark, s, a="night", b="nacht") == pytest.approx(1 / 7)
    assert one(spark, s, a="", b="x") == 0


@pytest.mark.parametrize(
    "text,intent",
    [
        ("find the login handler", "find"), ("explain how auth works", "explain"), ("list all classes", "list"), ("compare A and B", "compare"),
        ("how to deploy", "how"), ("why is it slow", "why"), ("fix the crash in the parser", "debug"), ("hello there", "general"),
    ],
)
def test_intent(spark, text, intent):
    assert one(spark, Q.intent(F.col("t"))["intent"], t=text) == intent


def test_mentions():
    got = [(t, k) for t, k, _ in Q.find_mentions("where is `AuthService` in src/auth/login.ts and doLogin() of UserStore")]
    assert got == [("AuthService", "class"), ("src/auth/login.ts", "file"), ("doLogin", "function"), ("UserStore", "class")]
    assert Q.find_mentions("") == []


def test_keywords_and_expansion(spark):
    df = Q.parse(spark.createDataFrame([(1, "Where is the `login` function, 42?")], "query_id int, text string"))
    r = df.first()
    assert r.normalized == "Where is the login function, 42"
    assert r.keywords == ["login", "function"]
    assert {"method", "callback"} <= set(r.expanded) and "function" not in r.expanded
    assert [v.text for v in Q.variants(df).orderBy("variant").collect()][:2] == ["Where is the login function, 42", "login function"]


@pytest.mark.parametrize(
    "text,retrieve,reason",
    [
        ("what's 2 + 2", False, "basic"), ("Hello!", False, "greeting"), ("ok", False, "confirmation"), ("what is a variable", False, "general"),
        ("where is AuthService used", True, "mention"), ("find the bug", True, "intent"), ("tell me about our deployment", True, "default"),
    ],
)
def test_gate(spark, text, retrieve, reason):
    g = Q.parse(spark.createDataFrame([(1, text)], "query_id int, text string")).first().gate
    assert (g.retrieve, g.reason) == (retrieve, reason)


def test_weights(spark):
    def w(text):
        return Q.parse(spark.createDataFrame([(1, text)], "query_id int, text string")).first().weights

    assert w("partition ledger notes").keyword == pytest.approx(0.6)
    assert w("how do ledgers balance accounts").semantic == pytest.approx(1.5)
    x = w("AuthService")
    assert (x.keyword, x.semantic, x.graph) == (pytest.approx(0.6 * 1.5 * 2), pytest.approx(0.5), pytest.approx(0.8 * 1.3))
    assert w("src/auth/login.ts").keyword == 3


def test_decompose(spark, rows):
    df = spark.createDataFrame([(1, "how does login work? where is the cache"), (2, "parse the config and render the page"), (3, "parse config then write output"), (4, "simple"), (5, None)], "query_id int, text string")
    got = rows(Q.decompose(df), "query_id", "part", "weight")
    assert got == [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 1.0), (2, 1, 1.0), (3, 0, 1.0), (3, 1, 0.9), (4, 0, 1.0)]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("generalizations", "gener"), ("oscillators", "oscil"), ("sky", "sky"), ("at", "at")])
def test_porter(word, stem):
    assert search.porter(word) == stem


def test_ignore_rules(spark):
    globs = [*files.default_globs(), *files.ignore_globs("# c\n!keep\nlogs/\n/top.txt\n*.tmp\nsub/x.md\n")]
    paths = {
        "node_modules/a/b.js": True, "src/a.ts": False, "a/node_modules/b.js": True, "x.min.js": True, "deep/x.min.js": True, "logs/a": True, "a/logs/b": True,
        "top.txt": True, "a/top.txt": False, "a/b.tmp": True, "sub/x.md": True, "y/sub/x.md": False, ".env.local": True, "src/lockfile.ts": False,
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.x for r in df.select("p", files.ignored(F.col("p"), globs).alias("x")).collect()} == paths


def test_code_descriptions(spark):
    text = "/** Does it. */\nexport class A {\n  private x: number\n  run(a: string): void {\n    return go()\n  }\n}"
    assert one(spark, C.summarize(F.lit("class"), F.col("t")), t=text) == "/** Does it. */\nexport class A {\n  private x: number\n  run(a: string): void"
    assert one(spark, C.summarize(F.lit("function"), F.col("t")), t="function f(a) {\n  return 1\n}") == "function f(a)"
    assert one(spark, C.meaningful_lines(F.col("t")), t="// c\n\nx = 1\n}\ny") == "x = 1\ny"
    assert one(spark, C.type_names(F.col("t")), t="Promise<Array<User>> | null") == ["User"]
    assert [one(spark, C.is_private(F.col("t")), t=x) for x in ("_a", "__init__", "b")] == [True, False, False]
    assert [one(spark, C.is_external(F.col("t")), t=x) for x in ("./a", "react")] == [False, True]
    assert [one(spark, C.node_type(F.col("t")), t=x) for x in ("a.ts::f", "a.ts", "react")] == ["symbol", "file", "module"]
    assert one(spark, C.describe(F.lit("function"), F.lit("f"), F.col("t"), F.lit("(a)")), t=None) == "Function f (a)"
    assert one(spark, C.describe(F.lit("function"), F.lit("f"), F.col("t"), F.lit("(a)")), t="Does.\nMore") == "Does."
