import random

import numpy as np

from paperloom.llm import nearcopies as N


def library(seed=1, n=140):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)] + ["the", "of", "and", "in", "for"] * 40
    rows = []
    for i in range(n):
        size = rng.choice([1, 3, 6, 20, 60, 200])
        text = rng.choices(words, k=size)
        rows.append((f"id{i:04d}", "Title " + text[0], " ".join(text), f"{text[-1]}.pdf"))
        for c in range(rng.choice([0, 0, 1, 3])):
            edited = [w for w in text if rng.random() > rng.choice([0.0, 0.05, 0.2])] or text
            if rng.random() < 0.4:
                edited.insert(rng.randrange(len(edited) + 1), "new")
            rows.append((f"id{i:04d}c{c}", "Title " + text[0], " ".join(edited), rows[-1][3]))
    rows += [("blank", "t", " ...", "f"), ("null", None, None, None), (None, "t", "a b c", "f"), ("alone", None, "word", None), ("zh1", None, "我们提出一种新的方法来描述土壤湿度", None), ("zh2", "", "我们提出一种新的方法来描述土壤温度", None), (" ID0001 ", rows[1][1], rows[1][2], rows[1][3])]
    return rows


def brute(rows):
    sets = {}
    for i, t, a, f in rows:
        if i is not None and a and any(c.isalnum() for c in a):
            words = N._WORD.findall(" ".join(x or "" for x in (t, a, f)).lower())
            s = set(zip(words, words[1:]))
            i = i.strip().lower()
            if i not in sets or len(s) > len(sets[i]):
                sets[i] = s
    ids = sorted(sets)
    return {(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.6 * len(sets[x] | sets[y])}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, title string, abstract string, file_name string, size int, class string")


def test_against_brute_force(spark):
    rows = library()
    want = brute(rows)
    got = {tuple(r) for r in N.found(frame(spark, rows)).collect()}
    assert got == want and len(want) > 50


def test_a_third_of_the_rows_are_copies(spark):
    rows = library(5, 60)
    rows += [(f"copy{i:03d}", *rows[20][1:]) for i in range(50)]
    got = {tuple(r) for r in N.found(frame(spark, rows)).collect()}
    assert got == brute(rows)
    groups = {r.paper_id: r for r in N.groups(frame(spark, rows)).collect()}
    assert len({groups[f"copy{i:03d}"].group_id for i in range(50)}) == 1 and groups["copy000"].links >= 49


def test_crowded_signatures_lose_nothing(spark):
    papers = frame(spark, library(2, 50))
    calm = {tuple(r)[:2] for r in N.links(papers).collect()}
    crowded = {tuple(r)[:2] for r in N.links(papers, hot=12).collect()}
    assert calm == crowded


def test_groups_hold_everyone(spark):
    rows = library(3)
    papers = frame(spark, rows)
    out = {r.paper_id: (r.group_id, r.links) for r in N.groups(papers).collect()}
    pairs = brute(rows)
    for a, b in pairs:
        assert out[a][0] == out[b][0]
    assert all(links == 0 for i, (g, links) in out.items() if not any(i in p for p in pairs))


def test_empty(spark):
    assert N.found(frame(spark, library()).limit(0)).count() == 0


def signed(features, role, instance=0):
    """The signatures of one set in one role, over all its bands."""
    classes = N.frequency_classes(np.arange(N.COUNTERS) % 97)
    flat, starts, sizes = N.ordered([features], classes)
    at, roles, bands = N.roles(sizes, 0.6)
    keep = roles == role
    return N.signatures(flat, starts[at[keep]], sizes[at[keep]], roles[keep], bands[keep], 0.6, instance)[1]


def test_borderline_pairs_share_a_signature():
    """Sets whose similarity is just at the threshold, over many sizes, in every instance."""
    rng = np.random.default_rng(0)
    for size in [2, 3, 4, 5, 8, 12, 20, 35, 50, 90, 200, 600]:
        for turn in range(60):
            other = rng.integers(int(np.ceil(0.6 * size)), size + 1)
            common = int(np.ceil(0.6 * (size + other) / 1.6))
            if common > min(size, other):
                continue
            base = rng.integers(0, 2**63, size + other).astype(np.uint64)
            a, b = np.unique(base[:size]), np.unique(np.concatenate([base[:common], base[size : size + other - common]]))
            if len(a) != size or len(b) != other or common == size == other:
                continue
            assert len(np.intersect1d(signed(b, N.SMALL, turn % 3), signed(a, N.LARGE, turn % 3)))
            apart = np.bitwise_count(N.sketch(a).view(np.uint64) ^ N.sketch(b).view(np.uint64)).sum()
            assert apart <= len(np.setxor1d(a, b))


def test_signatures_grow_with_the_size_and_stand_for_two_features():
    for size in (8, 60, 400, 5000):
        features = np.unique(np.random.default_rng(size).integers(1, 2**63, size).astype(np.uint64))
        assert len(signed(features, N.SMALL)) + len(signed(features, N.LARGE)) < 8 * size
    assert not len(signed(np.array([5], np.uint64), N.LARGE))


def test_still_crowded_after_all_instances(spark):
    reps = N.prepared(frame(spark, library(4, 50)))[1]
    calm = {tuple(r) for r in N.candidates(reps, 0.6).collect()}
    assert calm == {tuple(r) for r in N.candidates(reps, 0.6, hot=1, instances=1).collect()}


def test_dense_buckets_compare_alike(monkeypatch):
    rng = np.random.default_rng(3)
    n = 3000
    base = rng.integers(-(2**63), 2**63, (40, N.SKETCH))
    columns = {"sig": np.sort(rng.integers(0, 3, n)), "size": rng.integers(60, 120, n), "class": rng.permutation(n)}
    columns["role"] = np.zeros(n, np.int8)
    for g in range(3):
        at = np.flatnonzero(columns["sig"] == g)
        columns["role"][at[len(at) // 2 :]] = N.LARGE
    marks = base[rng.integers(0, 40, n)]
    columns |= {m: np.ascontiguousarray(marks[:, i]) for i, m in enumerate(N._MARKS)}
    dense = set(zip(*N._compare(columns, 0.6)))
    monkeypatch.setattr(N, "DENSE", 1 << 40)
    assert dense == set(zip(*N._compare(columns, 0.6))) and len(dense) > 1000
