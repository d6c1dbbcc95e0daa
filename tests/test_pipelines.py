import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwell import indexing, providers, retrieval, schemas, store
from siftwell.operators import agents

NOW = dt.datetime(2024, 1, 1)
FILES = [
    ("src/auth.ts", "import { UserStore } from './store'\nexport class AuthService extends Base {\n  login(name: string): boolean {\n    return check(name)\n  }\n}\n"),
    ("src/store.ts", "export class Base {\n}\nexport class UserStore {\n  find(id: string) {\n  }\n}\n"),
    ("lib/a.py", "import lib.b\nclass A:\n    '''Adds.'''\n    def f(self): return 1\n"),
    ("lib/b.py", "def g(): pass\n"),
]
DOC = [("docs/auth.md", "# Auth\nSee `AuthService` and src/store.ts.\n## Requirements\n- Users must log in\n")]


@pytest.fixture(scope="module")
def indexed(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    e, g = indexing.code_entities(files, NOW)
    d, h = indexing.document_entities(spark.createDataFrame(DOC, "path string, content string"), e, NOW)
    e = e.unionByName(d).cache()
    edges = g.unionByName(h).withColumn("id", F.concat_ws("|", "source_id", "target_id", "relationship")).withColumn("metadata", F.lit(None).cast("map<string,string>")).withColumn("created_at", F.lit(NOW))
    return e, edges.select("id", "source_id", "target_id", "relationship", "weight", "metadata", "created_at").cache()


def test_indexing(spark, rows, indexed):
    e, g = indexed
    assert schemas.invalid(e, schemas.ENTITIES) == [] and schemas.invalid(g, schemas.RELATIONSHIPS) == []
    names = {r.id: r.qualified_name for r in e.collect()}
    assert {"src/auth.ts", "src/auth.ts::AuthService", "src/auth.ts::AuthService::login", "lib/a.py::A::f", "docs/auth.md", "docs/auth.md::auth"} <= set(names.values())
    got = {(names[r.source_id], names[r.target_id], r.relationship) for r in g.collect()}
    assert {
        ("src/auth.ts", "src/store.ts", "IMPORTS"), ("lib/a.py", "lib/b.py", "IMPORTS"), ("src/auth.ts::AuthService", "src/store.ts::Base", "EXTENDS"),
        ("src/auth.ts", "src/auth.ts::AuthService", "CONTAINS"), ("docs/auth.md::auth", "docs/auth.md::requirements", "CONTAINS"),
        ("docs/auth.md::auth", "src/auth.ts::AuthService", "DOCUMENTS"), ("docs/auth.md::auth", "src/store.ts", "DOCUMENTS"),
    } <= got
    assert e.where("type = 'requirement'").first().metadata == {"priority": "must"}


def test_incremental(spark, rows, indexed):
    e, _ = indexed
    old = spark.createDataFrame([("src/auth.ts", "1"), ("src/store.ts", "1"), ("gone.ts", "1")], "path string, md5 string")
    new = spark.createDataFrame([("src/auth.ts", "2", "export class Changed {\n}\n"), ("src/store.ts", "1", "")], "path string, md5 string, content string")
    fresh, gone = indexing.incremental(old, new)
    assert rows(fresh, "path") == [("src/auth.ts",)] and rows(gone) == [("gone.ts",), ("src/auth.ts",)]
    after = indexing.apply(e, indexing.code_entities(fresh, dt.datetime(2025, 1, 1))[0], gone)
    assert rows(after.where("file_path = 'src/auth.ts'"), "name") == [("Changed",), ("auth.ts",)]
    assert after.where("qualified_name = 'src/auth.ts'").first().created_at == NOW


def test_pdf_pages(spark, rows):
    p = spark.createDataFrame([("a.pdf", 1, "x" * 60), ("a.pdf", 2, "short"), ("b.pdf", 1, None)], "path string, page int, text string")
    assert rows(indexing.pdf_entities(p, NOW), "type", "qualified_name") == [("document", "a.pdf"), ("document", "b.pdf"), ("section", "a.pdf::page-1")]


def test_context_query(spark, indexed):
    e, g = indexed
    vec = providers.embed(e.select("id", F.coalesce("content", "name").alias("t")), "t", providers.MockEmbedding)
    vec = vec.select(F.col("id").alias("entity_id"), F.lit("mock").alias("model_id"), "embedding")
    q = spark.createDataFrame([(1, "where is AuthService defined"), (2, "hello"), (3, "explain our login and also find UserStore"), (4, "")], "query_id int, text string")
    got = {r.query_id: r for r in retrieval.context_query(q, e, g, vec, providers.MockEmbedding).collect()}
    assert "AuthService" in got[1].context and got[1].confidence > 0 and got[1].tokens <= 4000
    assert not got[2].retrieve and got[2].context == "" and got[2].reason == "greeting"
    parts = {r.query_id: r for r in retrieval.context_query(q, e, g, decompose=True).collect()}
    assert "UserStore" in parts[3].context and set(parts) == {1, 2, 3, 4}


def test_store(spark, rows, tmp_path, indexed):
    e, g = indexed
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.projects() == [] and s.read("entities", "p1").count() == 0
    s.append("entities", "p1", e)
    s.append("relationships", "p2", g)
    assert s.projects() == ["p1", "p2"] and dict(rows(s.status("p1")))["entities"] == e.count()
    s.replace("entities", "p1", s.read("entities", "p1").where("type = 'class'"))
    assert rows(s.read("entities", "p1").select("type").distinct()) == [("class",)]
    s.rename("p1", "p3")
    s.drop("p2")
    assert s.projects() == ["p3"]
    for bad in (lambda: s.append("entities", "Bad Name", e), lambda: s.append("entities", "p", g)):
        with pytest.raises(ValueError):
            bad()
    line = store.as_inserts(spark.createDataFrame([(1, "it's", None, [1])], "a int, b string, c string, d array<int>"), "t").first().line
    assert line == "INSERT INTO t (a, b, c, d) VALUES (1, 'it''s', NULL, '[1]');"


def test_checkpoints_and_plans(spark, rows):
    old = spark.createDataFrame([(f"c{i}", "s", i, "{}", None, "auto", 1, None, NOW) for i in range(1, 11)], schemas.CHECKPOINTS)
    new = spark.createDataFrame([("n1", "s", 0, "{}", None, "auto", 1, None, NOW), ("n2", "t", 0, "{}", None, "auto", 1, None, NOW)], schemas.CHECKPOINTS)
    got = agents.save(old, new)
    assert got.where("session_id = 's'").count() == 10
    assert rows(agents.latest(got), "id", "step_number") == [("n1", 11), ("n2", 1)]
    steps = spark.createDataFrame([("p", "a", "failed", []), ("p", "b", "pending", ["a"]), ("p", "c", "pending", ["b"]), ("p", "d", "done", []), ("p", "e", "pending", ["d"]), ("p", "f", "pending", ["e"])], "plan_id string, id string, status string, dependencies array<string>")
    assert dict(rows(agents.ready(steps), "id", "next")) == {"a": None, "b": "skip", "c": "skip", "d": None, "e": "run", "f": "wait"}


def test_replace_survives_a_failure_between_its_renames(spark, rows, tmp_path):
    from siftwell import schemas
    from siftwell.store import Store

    store = Store(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([("a", "n", "active", None, None, None, None)], schemas.SESSIONS)
    store.append("sessions", "p", one)
    store.replace("sessions", "p", store.read("sessions", "p").unionByName(one.withColumn("id", one.name)))
    assert rows(store.read("sessions", "p"), "id") == [("a",), ("n",)]
    folder = tmp_path / "store/sessions"
    (folder / "project_id=p").rename(folder / "_old-p")  # stopped after the first rename
    assert rows(store.read("sessions", "p"), "id") == [("a",), ("n",)]
    assert store.projects() == ["p"]
