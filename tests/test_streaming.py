import datetime as dt

from siftwell import providers
from siftwell.streaming import events as S
from siftwell.streaming import memory as M

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def stream(spark, path, schema, transform, mode, out):
    src = spark.readStream.schema(schema).json(str(path))
    q = transform(src).writeStream.outputMode(mode).format("memory").queryName(out).option("checkpointLocation", str(path) + "-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(out)


def test_debounce_batch_and_stream(spark, rows, tmp_path):
    schema = "path string, change string, ts timestamp"
    data = [("a", "add", at(0)), ("a", "change", at(200)), ("a", "unlink", at(450)), ("a", "add", at(2000)), ("b", "change", at(100)), (None, "add", at(1))]
    df = spark.createDataFrame(data, schema)
    want = [("a", "add", 1), ("a", "unlink", 3), ("b", "change", 1)]
    assert rows(S.debounce(df), "path", "change", "n_events") == want
    df.coalesce(1).write.json(str(tmp_path / "in"))
    spark.createDataFrame([("z", "add", at(99999))], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    got = rows(stream(spark, tmp_path / "in", schema, lambda s: S.debounce(s, late="1 second"), "append", "bounced"), "path", "change", "n_events")
    assert set(want) <= set(got) | {("z", "add", 1)}


def test_windows(spark, rows):
    df = spark.createDataFrame([(at(h * 3_600_000), "x") for h in (0, 1, 25)], "ts timestamp, k string")
    assert rows(S.windowed(df, "1 day", "k"), "n_events") == [(1,), (2,)]
    assert rows(S.windowed(df, "2 days", "k", "1 day"), "n_events") == [(1,), (2,), (3,)]


ITEMS = "session_id string, id string, token_count int, relevance_score double, created_at timestamp, access_count int"


def items(n=8):
    return [("s", f"i{k}", 1000, k / 10, at(k), 5 if k % 2 else 0) for k in range(n)] + [("t", "j", 10, 0.5, at(0), 0), (None, "x", 1, 0.1, at(0), 0)]


def test_auto_spill(spark, rows):
    got = rows(M.auto_spill(spark.createDataFrame([*items(), items()[0]], ITEMS)))
    moves = [(i, f, t) for s, i, f, t in got if s == "s" and f == "hot"]
    assert moves == [("i0", "hot", "cold"), ("i1", "hot", "warm"), ("i2", "hot", "cold"), ("i3", "hot", "warm")]
    assert sum(f == "new" for _, _, f, _ in got) == 9


def test_auto_spill_stream_equals_batch(spark, rows, tmp_path):
    df = spark.createDataFrame(items(), ITEMS)
    for k in range(2):  # two files, two triggers, and a repeated row in the second
        part = [r for i, r in enumerate(items()) if i // 4 == k or (k == 1 and i in (0, 8, 9))]
        spark.createDataFrame(part, ITEMS).coalesce(1).write.mode("append").json(str(tmp_path / "m"))
    got = rows(stream(spark, tmp_path / "m", ITEMS, M.auto_spill, "append", "spilled"))
    assert got == rows(M.auto_spill(df))


def test_reference_state_on_a_stream(spark, rows, tmp_path):
    schema = "key string, refs long, existing long, removed long, born timestamp, first_ref timestamp"
    spark.createDataFrame([("a", 1, 0, 0, None, at(0)), ("a", 1, 0, 0, None, at(5)), ("b", 0, 1, 0, at(0), None)], schema).coalesce(1).write.json(str(tmp_path / "d"))
    got = stream(spark, tmp_path / "d", schema, S.running_references, "complete", "state")
    assert rows(got, "key", "refs", "existing") == [("a", 2, 0), ("b", 0, 1)]


def test_file_stream(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_text("hello")
    s = S.read_files(spark, str(tmp_path / "f"))
    q = s.writeStream.format("memory").queryName("files").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("files").first().content == "hello"


def test_providers(spark):
    class Failing(providers.MockEmbedding):
        def embed(self, texts, query=False):
            if "bad" in texts:
                raise RuntimeError("no")
            return providers.MockEmbedding.embed(self, texts, query)

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, t string")
    got = {r.id: r for r in providers.embed(df, "t", Failing, batch=1).collect()}
    assert len(got[1].embedding) == 128 and got[1].error is None
    assert got[2].embedding is None and got[2].error == "no" and got[3].embedding is None
    assert providers.complete(df, "t", providers.MockText).where("id = 1").first().response == "good"


def test_model_answers(spark):
    text = "OVERVIEW: All fine.\nTOPICS:\n- a\n- b\nDECISIONS:\n1. use x\n"
    r = spark.createDataFrame([(text, 'x [{"name":"A","type":"class","confidence":3}, {"type":"t"}]', "score 12", "{bad", "DECISION: one\nCONTEXT: c\nDECISION: two\n")], "a string, b string, c string, d string, e string")
    x = r.select(providers.summary(r.a).alias("s"), providers.entities(r.b).alias("e"), providers.score(r.c).alias("n"), providers.gate(r.d).alias("g"), providers.decisions(r.e).alias("d")).first()
    assert x.s.overview == "All fine." and x.s.topics == ["a", "b"] and x.s.decisions == ["use x"]
    assert [(e.name, e.confidence) for e in x.e] == [("A", 1.0)] and x.n == 10 and (x.g.retrieve, x.g.confidence) == (True, 0.5)
    assert [d.description for d in x.d] == ["one", "two"]
