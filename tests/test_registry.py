import ast
from pathlib import Path

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) > 90
    assert {"p2_found", "context_query", "keyword_bm25_topk"} <= set(q)
    assert all(callable(f) for f in q.values()) and all(isinstance(t, str) for t in s.values())


def test_nothing_outside_imports_the_subpackage():
    for path in [ROOT / "__spark_entry__.py", *(ROOT / "siftwell").rglob("*.py")]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("siftwell.llm") for n in names), path


def test_no_local_checkpoints():
    for path in (ROOT / "siftwell").rglob("*.py"):
        assert "localCheckpoint" not in path.read_text(), path


def test_entry_runs_on_a_small_folder(spark):
    df = E.queries()["edge_type_stats"](spark, "/root/testdata/sf0.001") if Path("/root/testdata/sf0.001").exists() else None
    assert df is None or df.columns == ["relationship", "n_edges"]
