from pyspark.sql import functions as F

from paperloom.operators import conversation as C
from paperloom.operators import library as L
from paperloom.operators import retrieval as R
from paperloom.operators import sections as S
from paperloom.operators import settings as P


def test_papers_without_pages_get_a_root_that_ends_before_the_first(spark):
    pages = spark.createDataFrame([("a", 0, "first page of our own text"), ("a", 1, None)], "paper_id string, page_no int, text string")
    papers = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    asked = []
    roots, leaves = S.build_index(pages, papers=papers)
    got = {r.paper_id: (r.end_page, r.n_leaves) for r in roots.collect()}
    assert got == {"a": (1, 1), "b": (-1, 0)} and {r.paper_id for r in leaves.collect()} == {"a"} and not asked
    assert S.build_index(pages)[0].count() == 1


def test_the_prompt_window_ends_at_the_question(spark):
    messages = spark.createDataFrame([("c", 1, "a", "x"), ("c", 2, "b", "y"), ("c", 3, "z", "later"), ("d", 1, "a", "other")], "conversation_id string, timestamp long, id string, content string")
    ends = spark.createDataFrame([("c", 2, "b")], "conversation_id string, t long, i string").select("conversation_id", F.struct(F.col("t").alias("timestamp"), F.col("i").alias("id")).alias("end"))
    assert sorted(r.content for r in C.up_to(messages, ends).collect()) == ["x", "y"]


def test_answers_become_messages(spark):
    replies = spark.createDataFrame([("c", "q", "Pages 1–2: A | Pages 3–3: B", "yes"), ("d", "q", "", "no"), ("e", "q", "", None)], "conversation_id string, question string, sources string, reply string")
    rows = {r.conversation_id: r for r in R.exchanged(replies, 9).collect()}
    assert set(rows) == {"c", "d"} and rows["c"].sources == ["Pages 1–2: A", "Pages 3–3: B"] and rows["d"].sources == [] and rows["c"].role == "assistant" and rows["c"].id != rows["d"].id


def test_settings_come_out_decoded(spark):
    rows = spark.createDataFrame([("a", '"text"'), ("b", "2"), ("c", "{broken"), ("d", None), ("e", '{"x":1}')], "key string, value string")
    assert [[r.value for r in P.decoded(rows, k).collect()] for k in "abcdef"] == [["text"], ["2"], [None], [None], ['{"x":1}'], []]


def test_import_stages(spark):
    df = spark.createDataFrame([("pending", False), ("parsing", False), ("saving", True), ("done", True), ("error", False), (None, False), ("odd", True)], "s string, f boolean")
    assert [r[0] for r in df.select(L.advanced(F.col("s"), F.col("f"))).collect()] == ["parsing", "saving", "error", "done", "error", None, "odd"]
