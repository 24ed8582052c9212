import random

import __spark_entry__ as entry
from paperloom.functions.model_call import with_reply
from paperloom.operators import retrieval as R
from paperloom.operators import sections as S
from paperloom.schema import TABLES


def pages(spark, papers):
    return spark.createDataFrame([(p, i, t) for p, texts in papers.items() for i, t in enumerate(texts)], TABLES["paper_pages"])


def leaves(spark, papers):
    out = {}
    for r in S.leaf_ranges(pages(spark, papers)).orderBy("paper_id", "leaf_no").collect():
        out.setdefault(r.paper_id, []).append((r.start_page, r.end_page))
    return out


def fold(ranges):
    """Small ranges join the one before, a small first one the one after."""
    out = list(ranges)
    i = 0
    while i < len(out):
        if out[i][1] - out[i][0] + 1 < 2 and len(out) > 1:
            at = i - 1 if i else 0
            out[at : at + 2] = [(out[at][0], out[at + 1][1])]
        else:
            i += 1
    return out


def test_leaf_ranges(spark):
    prose = "only prose here"
    got = leaves(spark, {"none": [prose] * 11, "one": [prose, "1. Introduction\nx", prose], "two": [prose, prose, "2. Methods\nx", prose, "3. Results\nx"], "single": ["x"], "first": ["Abstract\n", "Introduction\n", "Conclusion\n"]})
    assert got["none"] == [(0, 4), (5, 9), (10, 10)]
    assert got["one"] == [(0, 2)]
    assert got["two"] == [(0, 1), (2, 4)]
    assert got["single"] == [(0, 0)]
    assert got["first"] == [(0, 2)]


def test_merge_equals_the_fold(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for n in range(400):
        start, ranges = 0, []
        for _ in range(rng.randint(1, 8)):
            size = rng.choice([1, 1, 1, 2, 3, 5])
            ranges.append((start, start + size - 1))
            start += size
        rows += [(f"p{n}", a, b) for a, b in ranges]
        want[f"p{n}"] = fold(ranges)
    out = {}
    for r in S.merged_small(spark.createDataFrame(rows, "paper_id string, start_page int, end_page int")).orderBy("paper_id", "start_page").collect():
        out.setdefault(r.paper_id, []).append((r.start_page, r.end_page))
    assert out == want


def test_missing_and_repeated_pages(spark):
    df = spark.createDataFrame([("p", 0, "a"), ("p", 0, None), ("p", 6, "b"), (None, 1, "x"), ("q", None, "x")], TABLES["paper_pages"])
    assert [(r.start_page, r.end_page) for r in S.leaf_ranges(df).orderBy("leaf_no").collect()] == [(0, 4), (5, 6)]
    assert S.leaf_ranges(df.limit(0)).count() == 0


def test_index_with_canned_replies(spark):
    calls = []
    df = pages(spark, {"p": ["x", "x", "1. Introduction\n", "x", "2. Methods\n"], "q": ["lonely"]})
    path = spark.sparkContext.accumulator(0)

    def model(prompt):
        path.add(1)
        if prompt.startswith("Describe") and "lonely" in prompt:
            raise RuntimeError("busy")
        return '```json\n{"title":"Kiln survey","summary":"What the kilns were fed"}\n```'

    roots, found = S.build_index(df, model)
    got = {(r.paper_id, r.leaf_no): (r.title, r.summary) for r in found.collect()}
    assert got == {("p", 0): ("Kiln survey", "What the kilns were fed"), ("p", 1): ("Kiln survey", "What the kilns were fed"), ("q", 0): ("Pages 1–1", "")}
    root = {r.paper_id: (r.title, r.start_page, r.end_page, r.n_leaves) for r in roots.collect()}
    assert root == {"p": ("Kiln survey", 0, 4, 2), "q": ("Pages 1–1", 0, 0, 1)}
    assert path.value == 4 and not calls  # three leaves, one root of two leaves


TREE = [("Soil", 0, 1), ("Glaze", 2, 3), ("Firing", 4, 5)]


def select(spark, reply, tree=TREE):
    known = spark.createDataFrame([("p", i, t, "", a, b) for i, (t, a, b) in enumerate(tree)], TABLES["section_leaves"])
    texts = pages(spark, {"p": [f"sheet {i}" for i in range(6)]})
    scores = R.score_rows(spark.createDataFrame([("p", reply)], "paper_id string, reply string"), ["paper_id"])
    chosen = R.selected_leaves(scores, known, ["paper_id"])
    context = R.paper_contexts(chosen, texts).collect()
    return [r.selection_status for r in chosen.collect()], context[0].sources.split(" | ") if context else [], context[0].context if context else ""


def test_selection(spark):
    assert select(spark, '[{"id":1,"score":9},{"id":0,"score":2},{"id":2,"score":1}]')[1:] == (["Pages 3–4: Glaze"], "sheet 2\n\nsheet 3")
    both = select(spark, '[{"id":2,"score":8},{"id":1,"score":5},{"id":0,"score":1}]')
    assert both[1] == ["Pages 3–4: Glaze", "Pages 5–6: Firing"] and "\n\n---\n\n" in both[2]
    assert select(spark, '[{"id":0,"score":7},{"id":1,"score":3}]')[1] == ["Pages 1–2: Soil"]
    assert select(spark, '[{"id":0,"score":7},{"id":1,"score":4}]')[1] == ["Pages 1–2: Soil", "Pages 3–4: Glaze"]
    assert select(spark, '[{"id":1,"score":5},{"id":2,"score":5},{"id":0,"score":5}]')[1] == ["Pages 3–4: Glaze", "Pages 5–6: Firing"]
    assert select(spark, '```json\n[{"id":2,"score":0}]\n```')[1] == ["Pages 5–6: Firing"]
    assert select(spark, '[{"id":2,"score":"9"},{"id":1,"score":"10"}]')[1][0] == "Pages 3–4: Glaze"
    for reply in ("nothing", "[]", '{"id":1,"score":9}', None, "", "null"):
        status, sources, _ = select(spark, reply)
        assert status == ["fallback"] and sources == ["Pages 1–2: Soil"]
    assert select(spark, '[{"id":99,"score":9}]')[0] == ["invalid_id"]
    assert select(spark, "nothing", [("All", 0, 2)]) == (["single"], ["Pages 1–3: All"], "sheet 0\n\nsheet 1\n\nsheet 2")


def test_answer_pipeline(spark):
    convs = spark.createDataFrame([("c1", "t", ["p", "gone"], 1), ("c2", "t", ["gone"], 1), ("c3", "t", None, 1)], TABLES["conversations"])
    messages = spark.createDataFrame([("m1", "c1", "user", "first?", [], 1), ("m2", "c1", "assistant", "yes", [], 2), ("m3", "c1", "user", "and then?", [], 3), ("m4", "c2", "user", "x?", [], 1), ("m5", None, "user", "y", [], 1)], TABLES["messages"])
    known = spark.createDataFrame([("p", i, t, "", a, b) for i, (t, a, b) in enumerate(TREE)], TABLES["section_leaves"])
    asked = spark.sparkContext.accumulator(0)

    def model(prompt):
        asked.add(1)
        return '[{"id":1,"score":9}]' if prompt.startswith("Rate") else "  " if prompt.startswith("Rewrite") else "the answer"

    out = R.answer(convs, messages, known, pages(spark, {"p": [f"sheet {i}" for i in range(6)]}), model=model).collect()
    assert [(r.conversation_id, r.question, r.query, r.sources, r.reply) for r in out] == [("c1", "and then?", "and then?", "Pages 3–4: Glaze", "the answer")]
    assert asked.value == 3  # rewriting, rating, answer


def test_every_question_is_answered(spark, tmp_path):
    convs = [("c1", "t", ["p", "gone"], 1), ("c2", "t", ["gone"], 1), ("c3", "t", None, 1), ("c4", "t", ["q", "p"], 1), ("c5", "t", ["p"], 1), ("c6", "t", [], 1)]
    messages = [(f"{c}-{k}", c, role, f"{c} {k}?", [], k) for c in ("c1", "c2", "c3", "c4", "c6", "unknown") for k, role in enumerate(["user", "assistant", "user"])]
    texts = {"p": [f"sheet {i}" for i in range(6)], "q": ["lonely"], "r": ["not asked for"]}
    known = spark.createDataFrame([("p", i, t, "", a, b) for i, (t, a, b) in enumerate(TREE)], TABLES["section_leaves"])
    tables = {"conversations": spark.createDataFrame(convs, TABLES["conversations"]), "messages": spark.createDataFrame(messages, TABLES["messages"]), "section_leaves": known, "paper_pages": pages(spark, texts)}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = {r.conversation_id: r for r in entry.queries()["q_answer_pipeline"](spark, str(tmp_path)).collect()}
    assert sorted(out) == ["c1", "c2", "c3", "c4", "c6"]
    assert all(out[c].reply and out[c].question == f"{c} 2?" for c in out)
    assert all((out[c].context_chars, out[c].sources) == (0, "") for c in ("c2", "c3", "c6"))
    assert out["c4"].sources.startswith("Pages 1–1: Section of ") and out["c4"].sources.count("Pages") >= 2

    calls = spark.sparkContext.accumulator(0)

    def model(prompt):
        calls.add(1)
        return '[{"id":1,"score":9}]' if prompt.startswith("Rate") else prompt.split()[0]

    assert R.answers(*(tables[t] for t in ("conversations", "messages", "section_leaves", "paper_pages")), model=model).count() == 5
    assert calls.value == 3 + 1 + 1 + 5  # rewritings of c1, c2, c4; the leaf of q; one rating of p, as c1 and c4 are rewritten alike; answers


def test_failing_model_gives_null(spark):
    def model(prompt):
        raise RuntimeError

    assert with_reply(spark.createDataFrame([("x",), (None,)], "prompt string"), "prompt", "reply", model).where("reply is not null").count() == 0
