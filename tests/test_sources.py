import gzip

import pytest

from siftwell.sources import files, packages, parsers


def table(spark, *texts):
    return spark.createDataFrame([(p, t, "clash") for p, t in texts], "path string, content string, title string")


MD = """---
title: Guide
tags: [a]
---
Before
# One
Text [site](https://x.y) and [local](./z.md)
```py
# not a heading
x = 1
```
## Two
more
# Three
"""


def test_markdown(spark, rows):
    df = table(spark, ("g.md", MD), ("plain.md", "no headings"), ("null.md", None), ("empty.md", ""))
    s = parsers.markdown(df)
    got = {r.section_id: r for r in s.collect()}
    assert {k: (r.level, r.parent, r.start_line, r.end_line) for k, r in got.items()} == {"preamble": (0, None, 5, 5), "one": (1, None, 6, 11), "two": (2, "one", 12, 13), "three": (1, None, 14, 15)}
    assert got["one"].code_blocks[0].code == "# not a heading\nx = 1" and [x.is_internal for x in got["one"].links] == [False, True]
    assert rows(parsers.front_matter(df), "key", "value") == [("tags", '["a"]'), ("title", '"Guide"')]


@pytest.mark.parametrize("text,d,first", [("a,b\n1,2\n", ",", {"a": "1", "b": "2"}), ("a;b\n1;\"x;y\"\n", ";", {"a": "1", "b": "x;y"}), ("a\tb\n 1 \t\"d\"\"q\"\n\n", "\t", {"a": "1", "b": 'd"q'}), ("a|b|c\n1|2|3", "|", {"a": "1", "b": "2", "c": "3"})])
def test_csv(spark, text, d, first):
    r = parsers.csv(table(spark, ("f.csv", text), ("e.csv", ""))).collect()
    assert len(r) == 1 and r[0].delimiter == d and r[0]["values"] == first
    assert parsers.csv_summary(parsers.csv(table(spark, ("f.csv", text)))).first().n_rows == 1


def test_xml(spark, rows):
    pom = '<?xml version="1.0"?>\n<project xmlns="http://maven.apache.org/POM">\n<dependencies><dependency><artifactId>guava</artifactId></dependency></dependencies><!-- c --><description>A text of some length</description></project>'
    e = parsers.xml(table(spark, ("pom.xml", pom), ("bad.xml", "<a><b></a>")))
    assert rows(e.where("path = 'pom.xml'"), "element_path", "line") == sorted([("/project", 2), ("/project/dependencies", 3), ("/project/dependencies/dependency", 3), ("/project/dependencies/dependency/artifactId", 3), ("/project/description", 3)])
    assert e.where("error is not null").count() == 1
    assert rows(parsers.xml_entities(e.where("path = 'pom.xml'")), "type", "name") == [("section", "dependencies"), ("section", "description"), ("section", "project"), ("technology", "guava")]
    root = e.where("nth = 0").select("path", parsers.xml_kind(e.path, e.tag, e.attributes["xmlns"]).alias("kind"))
    assert dict(rows(root)) == {"pom.xml": "maven-pom", "bad.xml": None}


def test_configuration(spark, rows):
    df = table(spark, ("a.json", '{"x": 1, "o": {"y": 2}}'), ("b.toml", 'x = "s"\n[t]\ny = 1'), ("c.yaml", "x: 1\nl: [1]\n"), ("d.json", "{broken"), ("e.json", "[1]"))
    assert rows(parsers.config_keys(df), "path", "key", "kind") == sorted(
        [("a.json", "x", "variable"), ("a.json", "o", "component"), ("b.toml", "x", "variable"), ("b.toml", "t", "component"), ("c.yaml", "x", "variable"), ("c.yaml", "l", "component"), ("d.json", None, "text"), ("e.json", None, "text")], key=str
    )
    pkg = table(spark, ("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2", "a": "9"}, "scripts": {"test": "jest"}}'))
    assert rows(parsers.package_json(pkg), "type", "name", "value") == [("task", "test", "jest"), ("technology", "a", "1"), ("technology", "b", "2")]


def test_html(spark, rows):
    page = "<html><head><title> T </title><style>h1{}</style></head><body><h1>One <b>x</b></h1><p>a  b</p><!-- no --><h2></h2><h2>Two</h2><script>var x='<p>'</script></body></html>"
    df = table(spark, ("d/p.html", page), ("q.html", "<p>hi</p>"))
    assert rows(parsers.html(df), "title", "text") == [("T", "T One x a b Two"), ("q.html", "hi")]
    assert rows(parsers.html_sections(df), "level", "title", "content") == [(1, "One x", "a b"), (2, "Two", "Two")]


DIFF = """diff --git a/m.ts b/m.ts
--- a/m.ts
+++ b/m.ts
@@ -1,3 +1,4 @@ head
 one
-two
+2
+2b
 three
@@ -10 +11 @@
-x
+y
diff --git a/n.ts b/n.ts
new file mode 100644
--- /dev/null
+++ b/n.ts
@@ -0,0 +1,2 @@
+a
+b
diff --git a/o.ts b/p.ts
rename from o.ts
rename to p.ts
diff --git a/i.png b/i.png
Binary files differ"""


def test_diff(spark, rows):
    d = parsers.diff_lines(spark.createDataFrame([("d", DIFF), ("null", None), ("none", "text")], "diff_id string, content string"))
    assert rows(d.select("new_path", "old_path", "change", "is_binary").distinct()) == sorted([("m.ts", "m.ts", "modified", False), ("n.ts", None, "added", False), ("p.ts", "o.ts", "renamed", False), ("i.png", "i.png", "modified", True)], key=str)
    assert [(r.kind, r.old_line, r.new_line) for r in d.where("new_path = 'm.ts'").orderBy("hunk", "old_line", "new_line").collect() if r.kind != "context"][-2:] == [("added", None, 11), ("removed", 10, None)]
    assert rows(parsers.diff_totals(d)) == [("d", 4, 5, 2)]
    assert rows(parsers.changed_ranges(d), "path", "start", "end") == sorted([("m.ts", 2, 3), ("m.ts", 10, 11), ("n.ts", 1, 2)], key=str)
    s = parsers.name_status(spark.createDataFrame([("d", "M\ta\nD\tb\nR100\tc\td\n")], "diff_id string, content string"))
    assert rows(s, "status", "path") == [("A", "d"), ("D", "b"), ("D", "c"), ("M", "a")]


CODE = {
    "a.py": ("import os\nclass A(B):\n    '''Doc.'''\n    def f(self): pass\ndef g(x: int) -> int: return x\n", {("import", "os"), ("class", "A"), ("method", "A::f"), ("function", "g")}),
    "b.ts": ("import {x} from './x'\nexport class A extends B implements C {\n  run(): void {\n  }\n}\nconst f = (a) => 1\nenum E { A }\n", {("import", "./x"), ("class", "A"), ("method", "A::run"), ("function", "f"), ("enum", "E")}),
    "c.go": ('import "fmt"\nfunc (s *S) Do() {\n}\ntype S struct {\n}\n', {("import", "fmt"), ("function", "Do"), ("class", "S")}),
    "d.rs": ("use std::io;\npub fn go() {\n}\nstruct P {\n}\n", {("import", "std::io"), ("function", "go"), ("class", "P")}),
    "e.java": ("import a.B;\npublic class C {\n  public int f(int x) {\n  }\n}\n", {("import", "a.B"), ("class", "C"), ("method", "C::f")}),
    "f.cs": ("using System;\nnamespace N {\n  public interface I {\n  }\n}\n", {("import", "System"), ("module", "N"), ("interface", "N::I")}),
    "g.cpp": ("#include <x>\nclass A : public B {\n};\nint f(int a) {\n}\n", {("import", "x"), ("class", "A"), ("function", "f")}),
    "h.py": ("def broken(:\n", {("error", None)}),
    "i.txt": ("class X", set()),
}


def test_code(spark, rows):
    s = parsers.code(table(spark, *[(p, t) for p, (t, _) in CODE.items()], ("n.py", None)))
    got = {}
    for r in s.collect():
        got.setdefault(r.path, set()).add((r.type, r.qualified_name))
    assert got == {p: w for p, (_, w) in CODE.items() if w}
    e = rows(parsers.code_edges(s.where("path = 'b.ts'")), "source", "target", "relationship")
    assert {("b.ts::A", "B", "EXTENDS"), ("b.ts::A", "C", "EXTENDS"), ("b.ts", "b.ts::A", "CONTAINS"), ("b.ts::A", "b.ts::A::run", "CONTAINS"), ("b.ts", "./x", "IMPORTS")} <= set(e)


def test_read_tree(spark, rows, tmp_path):
    for p, t in {"src/a.py": "x = 1", "node_modules/m.js": "no", ".gitignore": "out/\n", "out/o.ts": "no", "big.ts": "y" * 100}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = rows(files.read_tree(spark, str(tmp_path), most_bytes=50), "path", "language", "content")
    assert got == sorted([("big.ts", "typescript", None), ("src/a.py", "python", "x = 1")], key=str)


def test_package_round_trip(spark, rows, tmp_path):
    a = spark.createDataFrame([("1", {"k": "v"}, [1.5, 2.0], None), ("2", None, None, "ü")], "id string, m map<string,string>, v array<double>, t string")
    packages.export({"a": a, "b": a.select("id")}, str(tmp_path / "p"))
    back = packages.install(spark, str(tmp_path / "p"))
    assert [r.asDict() for r in back["a"].orderBy("id").collect()] == [r.asDict() for r in a.orderBy("id").collect()]
    part = next((tmp_path / "p/b").glob("*.json.gz"))
    part.write_bytes(gzip.compress(b'{"id":"changed"}\n'))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="checksum"):
        packages.install(spark, str(tmp_path / "p"))
