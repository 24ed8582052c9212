import random

import numpy as np

from paperloom.llm import leakage as L

WORDS = [f"w{i}" for i in range(400)]


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, lang, item in items:
            words = L._UNIT.findall((item or "").lower())
            doc = L._UNIT.findall((text or "").lower())
            n = 12
            if lang == "zh":
                words, doc, n = list("".join(words)), list("".join(doc)), 24
            grams = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            if any(tuple(doc[k : k + n]) in grams for k in range(len(doc) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, "en", " ".join(rng.choices(WORDS, k=30))) for i in range(12)] + [(100 + i, "zh", "".join(rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往", k=40))) for i in range(6)]
    docs = []
    for d in range(60):
        _, lang, text = rng.choice(items)
        noise = " ".join(rng.choices(WORDS, k=20))
        units = text.split() if lang == "en" else list(text)
        k = rng.choice([6, 11, 12, 13, 23, 24, 25, 40])
        at = rng.randrange(max(1, len(units) - k + 1))
        piece = units[at : at + k]
        docs.append((d, f"{noise}. {' , '.join(piece).upper() if lang == 'en' else '，'.join(piece)} {noise}"))
    docs += [(1000, None), (1001, ""), (1002, "..."), (1003, items[0][2] * 1), (1004, (" ".join(WORDS) + " ") * 200 + items[1][2])]
    items += [(900, "en", None), (901, "en", "too short")]
    df = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id long, text string, item_id long")
    ev = spark.createDataFrame(items, "item_id long, lang string, text string")
    got = {tuple(r) for r in L.found(df, ev).collect()}
    want = brute(docs, items)
    assert got == want and want
    assert L.found(df.limit(0), ev).count() == 0 and L.found(df, ev.limit(0)).count() == 0


def test_one_item_in_a_third_of_the_documents(spark):
    rng = random.Random(9)
    item = " ".join(rng.choices(WORDS, k=30))
    docs = [(d, item if d % 3 == 0 else " ".join(rng.choices(WORDS, k=30))) for d in range(900)]
    got = {r.doc_id for r in L.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "en", item)], "item_id long, lang string, text string")).collect()}
    assert got == set(range(0, 900, 3))


def test_substitutions_are_tolerated():
    rng = np.random.default_rng(1)
    item = rng.integers(0, 1000, 60).astype(np.uint64)
    doc = item.copy()
    doc[[7, 20, 33, 46]] += 5000
    run, matched, length = L.longest_overlap(doc, item, 0, 3)
    assert run < 14 and matched == 56 and length == 60
    with np.errstate(over="ignore"):
        shared = sum(len(np.intersect1d(a, b)) for a, b in zip(L.seeds(doc, L.WORD_MASKS), L.seeds(item, L.WORD_MASKS)))
    assert shared > 0


def test_overlaps_agree_with_the_leaks(spark):
    rng = random.Random(4)
    item = rng.choices(WORDS, k=40)
    changed = [w if k % 13 != 5 else "other" for k, w in enumerate(item)]
    docs = [(1, " ".join(item[3:30])), (2, " ".join(changed)), (3, " ".join(rng.choices(WORDS, k=300))), (None, " ".join(item))]
    df, ev = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, "en", " ".join(item)), (None, "en", " ".join(item))], "item_id long, lang string, text string")
    rows = {r.doc_id: r for r in L.leaked_items(df, ev).collect()}
    assert {(r.doc_id, r.item_id) for r in rows.values() if r.leaked} == {tuple(r) for r in L.found(df, ev).collect()}
    assert rows[1].exact_run == 27 and rows[2].overlap > rows[2].exact_run
    assert L.leaked_items(df.limit(0), ev).count() == 0


def test_filters_keep_what_they_hold(spark):
    hashes = np.random.default_rng(2).integers(-(2**63), 2**63, 3000)
    bits = L.filter_bits(spark.createDataFrame([("x", int(h)) for h in hashes], "track string, seed long"))["x"]
    assert L._passes(bits, hashes.view(np.uint64)).all()
    others = np.random.default_rng(3).integers(-(2**63), 2**63, 3000).view(np.uint64)
    assert L._passes(bits, others).sum() < 30
