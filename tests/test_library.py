import random

from pyspark.sql import functions as F

from paperloom.operators import conversation as C
from paperloom.operators import library as L
from paperloom.operators import mutate as M
from paperloom.operators import settings as S
from paperloom.schema import TABLES
from paperloom.sources import export, ingest


def kbs(spark, *ids):
    return spark.createDataFrame([(i, i.upper(), None, "#000", n) for n, i in enumerate(ids)], TABLES["knowledge_bases"])


def papers(spark, *rows):
    return spark.createDataFrame([(i, kb, f"T{i}", ["A"], "abs", 2000, ["x", "y", "z"], "unread", f"{i}.pdf", f"/f/{i}.pdf", 5) for i, kb in rows], TABLES["papers"])


def test_counts_and_successor(spark):
    k = kbs(spark, "a", "b", "c")
    assert {r.id: r.papers for r in L.collection_counts(k, papers(spark, ("1", "a"), ("2", "a"), ("3", "zz"))).collect()} == {"a": 2, "b": 0, "c": 0}
    assert {r.id: r.next_id for r in L.collection_successor(k).collect()} == {"a": "b", "b": "c", "c": "a"}


def test_cards(spark):
    row = spark.createDataFrame([("1", "a", "", [], None, 0, None, "odd", "f.pdf", "p", 1)], TABLES["papers"])
    card = L.cards(row).first()
    assert (card.display_title, card.display_authors, card.first_author, card.display_year, card.preview, card.status_label) == ("f.pdf", "Unknown authors", "Unknown", "—", "", "odd")


def test_progress(spark):
    df = spark.createDataFrame([("a", "done"), ("a", "error"), ("a", "saving"), ("b", "done"), ("c", None)], "g string, status string")
    got = {r.g: (r.items, r.ended, r.percent, r.all_ended, r.any_error) for r in L.import_progress(df, "g").collect()}
    assert got["a"] == (3, 2, 67, False, True) and got["b"] == (1, 1, 100, True, False) and got["c"][:4] == (1, 0, 0, False)


def test_numbered(spark):
    rng = random.Random(1)
    values = [(rng.randrange(1000), f"i{i}") for i in range(500)]
    df = spark.createDataFrame(values, "t int, id string").repartition(7)
    got = {r.id: r.n for r in L.numbered(df, F.floor(F.col("t") / 50), [F.col("t"), F.col("id")], "n").collect()}
    assert got == {i: n + 1 for n, (_, i) in enumerate(sorted(values))}


def test_patch_keeps_and_replaces(spark):
    base = papers(spark, ("1", "a"), ("2", "a"))
    patch = spark.createDataFrame([("1", None, "done", None, True, None, False), ("9", "no", "done", None, True, None, True)], "id string, title string, status string, tags array<string>, set_tags boolean, authors array<string>, set_authors boolean")
    got = {r.id: r for r in M.papers_patched(base, patch).collect()}
    assert got["1"].title == "T1" and got["1"].status == "done" and got["1"].tags is None and got["1"].authors == ["A"]
    assert got["2"].status == "unread" and set(got) == {"1", "2"} and got["1"].file_name == "1.pdf"


def test_conversation_patch(spark):
    base = spark.createDataFrame([("1", "old", ["p"], 1), ("2", "old", ["p"], 1)], TABLES["conversations"])
    patch = spark.createDataFrame([("1", None, []), ("2", "new", None)], "id string, title string, paper_ids array<string>")
    assert {r.id: (r.title, r.paper_ids) for r in M.conversations_patched(base, patch).collect()} == {"1": ("old", []), "2": ("new", ["p"])}


def test_cascades(spark):
    k, p = kbs(spark, "default", "a"), papers(spark, ("1", "a"), ("2", "default"))
    pages = spark.createDataFrame([("1", 0, "x"), ("2", 0, "y"), (None, 0, "z")], TABLES["paper_pages"])
    out = M.collections_removed(k.where("id = 'a'").select("id"), k, p, {"paper_pages": pages})
    assert [r.id for r in out["knowledge_bases"].collect()] == ["default"] and [r.id for r in out["papers"].collect()] == ["2"]
    assert {r.paper_id for r in out["paper_pages"].collect()} == {"2", None}
    assert out["papers"].columns == p.columns


def test_insert_upsert_clear(spark):
    k = kbs(spark, "a")
    fresh = papers(spark, ("1", "a"), ("2", "nowhere"))
    assert [r.id for r in M.inserted(papers(spark), fresh, "id", k, "knowledge_base_id").collect()] == ["1"]
    assert [r.id for r in M.inserted(papers(spark, ("1", "a")), fresh, "id", k, "knowledge_base_id").collect()] == ["1"]
    s = spark.createDataFrame([("a", "1"), ("b", "2")], TABLES["settings"])
    assert {r.key: r.value for r in M.upserted(s, spark.createDataFrame([("b", "3"), ("c", "4")], TABLES["settings"]), ["key"]).collect()} == {"a": "1", "b": "3", "c": "4"}
    cleared = M.cleared({"knowledge_bases": k, "papers": fresh}, 7)
    assert cleared["papers"].count() == 0 and [(r.id, r.created_at) for r in cleared["knowledge_bases"].collect()] == [("default", 7)]
    assert M.seeded(k, 7).count() == 1


def test_profiles(spark):
    two = '[{"id":"p1","provider":"ollama"},{"id":"p2","provider":"openai"}]'
    s = spark.createDataFrame([("llm_profiles", two), ("llm_config", '{"model":"old"}')], TABLES["settings"])
    assert [r.id for r in S.profiles(s).orderBy("pos").collect()] == ["p1", "p2"]
    assert S.migrated(s).count() == 0
    assert S.migrated(s.where("key = 'llm_config'")).first().model == "old"
    asked = spark.createDataFrame([(1, "p2"), (2, "x"), (3, None)], "request int, profile_id string")
    assert {r.request: r.resolved for r in S.resolved(asked, S.profiles(s), None).collect()} == {1: "p2", 2: "p1", 3: "p1"}


def test_history(spark):
    rows = [(f"m{i}", "c", "user" if i % 2 == 0 else "assistant", f"t{i}", [], i) for i in range(6)]
    df = spark.createDataFrame(rows, TABLES["messages"])
    got = {r.id: (r.history, r.rewrite) for r in C.history_before(df).collect()}
    assert got["m0"] == ("", False) and got["m1"] == ("user: t0", False) and got["m4"] == ("assistant: t1\nuser: t2\nassistant: t3", True)
    assert C.transcripts(df, 2).first().transcript == "user: t4\nassistant: t5"


def test_nested_keeps_empty_conversations(spark):
    convs = spark.createDataFrame([("c", "t", [], 1), ("e", "t", [], 1)], TABLES["conversations"])
    df = spark.createDataFrame([("m", "c", "user", None, None, None)], TABLES["messages"])
    assert {(r.conv_id, r.n_messages, r.id) for r in C.placed_messages(convs, df).collect()} == {("c", 1, "m"), ("e", 0, None)}


def test_export_redacts_keys(spark):
    s = spark.createDataFrame([("llm_profiles", '[{"apiKey": "se\\"cret","id":"x"}]')], TABLES["settings"])
    assert "cret" not in export.bundle({"settings": s}).first().row
    assert "cret" in export.bundle({"settings": s}, redact=False).first().row


def test_import(spark, tmp_path):
    (tmp_path / "Good paper.PDF").write_text("Abstract: " + "words " * 30 + "2021\fsecond page")
    (tmp_path / "bad.pdf").write_bytes(b"\xff\xfe\xff")
    stored = ingest.files(spark, str(tmp_path))
    items, pages = ingest.imported(stored)
    got = {r.name: r for r in items.collect()}
    assert got["Good paper.PDF"].status == "done" and got["Good paper.PDF"].title == "Good paper" and got["Good paper.PDF"].year == 2021 and got["Good paper.PDF"].n_pages == 2
    assert got["bad.pdf"].status == "error" and "UnicodeDecodeError" in got["bad.pdf"].error
    assert {(r.name, r.page_no, r.text) for r in pages.collect()} >= {("Good paper.PDF", 1, "second page")}
    out = tmp_path / "out"
    assert ingest.stored_files(stored.select(F.col("name").alias("id"), "content"), str(out)) == 2
    assert len(list(out.iterdir())) == 2
    lib = spark.createDataFrame([("1", "/x/bad.pdf"), ("2", "/x/none.pdf")], "id string, file_path string")
    assert {r.id: r.content is None for r in ingest.file_of(lib, stored).collect()} == {"1": False, "2": True}


def test_streaming_index(spark, tmp_path):
    from paperloom.streaming.sections import keep_index, latest

    incoming, folder = tmp_path / "in", tmp_path / "index"
    schema = TABLES["paper_pages"]

    def arrive(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(incoming))
        keep_index(spark, str(incoming), str(folder), str(tmp_path / "ck")).awaitTermination(120)

    arrive(0, [("p", i, "x") for i in range(7)] + [("q", 0, "x")])
    arrive(1, [("p", i, "x") for i in range(7, 11)])
    found = latest(spark, str(folder / "leaves"), "")
    assert {(r.paper_id, r.leaf_no, r.end_page) for r in found.collect()} == {("p", 0, 4), ("p", 1, 9), ("p", 2, 10), ("q", 0, 0)}
