import random

import pytest

from paperloom.llm import splitting as S

TOPICS = ["The river delta shifts its course. Sediment and water reach the sea. ", "The court heard the case again. Judges and lawyers argued over the law. ", "这条河流的三角洲改变了方向。泥沙和河水流入大海。"]


def rebuild(text, pieces):
    out = text[: pieces[0][1]]
    for (_, e), (b, f) in zip(pieces, pieces[1:]):
        out += text[e:f]
    return out


@pytest.mark.parametrize("text", ["x" * 5000, "ab " * 2000, TOPICS[0] * 60, TOPICS[2] * 120, "\n\n".join(TOPICS * 40), "词" * 4001, "a" * 1001 + "\n\n" + "b" * 1500])
@pytest.mark.parametrize("limit,overlap", [(600, 60), (1000, 0), (300, 299)])
def test_limits_overlap_and_round_trip(text, limit, overlap):
    pieces = S.cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - b <= limit for b, e in pieces)
    assert all(e - b2 == overlap for (_, e), (b2, _) in zip(pieces, pieces[1:]))
    assert rebuild(text, pieces) == text


def test_within_limit():
    assert S.cut("short", 10, 2) == [] and S.cut("", 10, 2) == [] and S.cut(None, 10, 2) == [] and S.cut("0123456789", 10, 2) == []


def test_topic_boundary_wins():
    text = TOPICS[0] * 8 + TOPICS[1] * 8
    border = len(TOPICS[0]) * 8
    assert S.cut(text, 750, 0)[0][1] == border


def test_sentences_end_pieces():
    text = TOPICS[0] * 100
    assert all(text[:e].rstrip().endswith(".") for _, e in S.cut(text, 600, 60)[:-1])


def tables(spark):
    rng = random.Random(4)
    leaves = [("p1", 0, "t", "s" * 601, 0, 1), ("p1", 0, "t", "s" * 601, 0, 1), ("p1", 1, "t", " " * 600, 2, 99), ("p2", 0, "t", None, 0, 0), ("p3", 0, None, "", 0, -1), (None, 0, None, "x" * 700, 0, 0), ("p4", 0, "t", " " * 601, None, None)]
    pages = [("p1", 0, "a" * 1499), ("p1", 1, "b" * 1500), ("p1", 1, "b" * 1500), ("p1", 2, "c" * 1400), ("p1", 4, TOPICS[0] * 60), ("p2", 0, "d" * 3000), ("p9", 0, None)]
    rng.shuffle(pages)
    limits = [("summary", 600, 60), ("pages", 3000, 200)]
    return (
        spark.createDataFrame([(*r, "x") for r in leaves], "paper_id string, leaf_no int, title string, summary string, start_page int, end_page int, text string"),
        spark.createDataFrame([(*r, "x") for r in pages], "paper_id string, page_no int, text string, summary string"),
        spark.createDataFrame([(*r, "chars") for r in limits], "limit_name string, max_size int, overlap_size int, unit string"),
    )


def test_found(spark):
    leaves, pages, limits = tables(spark)
    got = {tuple(r) for r in S.found(leaves, pages, limits).collect()}
    assert got == {("p1", 0, "summary"), ("p1", 0, "pages"), ("p1", 1, "pages"), ("p4", 0, "summary")}
    pieces = S.pieces(leaves, pages, limits).where("paper_id = 'p1' and leaf_no = 0 and field = 'pages'").orderBy("piece_no").collect()
    assert pieces[0].text[:1499] == "a" * 1499 and pieces[1].begin == pieces[0].end - 200


def test_empty(spark):
    leaves, pages, limits = tables(spark)
    assert S.found(leaves.limit(0), pages, limits).count() == 0
    assert {r.field for r in S.found(leaves, pages.limit(0), limits).collect()} == {"summary"}
    assert S.found(leaves, pages, limits.limit(0)).count() == 0


def test_the_deepest_valley_wins_over_a_paragraph_break():
    text = TOPICS[0] * 5 + "\n\n" + TOPICS[0] * 3 + TOPICS[1] * 9
    border = len(TOPICS[0]) * 8 + 2
    assert S.cut(text, 900, 0)[0][1] == border


def test_the_kind_of_mark_decides_between_equal_depths():
    text = ("same words again. " * 20).strip() + "\n\n" + ("same words again. " * 60).strip()
    assert S.cut(text, 600, 0)[0][1] == text.index("\n\n") + 2
