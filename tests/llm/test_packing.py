import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import packing as P


def best(sizes, capacity):
    """The least number of bins by search, for few items."""
    sizes = sorted(sizes, reverse=True)
    found = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= sizes[i]:
                at = rooms.index(k)
                place(i + 1, rooms[:at] + [k - sizes[i]] + rooms[at + 1 :])
        place(i + 1, rooms + [capacity - sizes[i]])

    place(0, [])
    return found[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_bound_and_packing(sizes):
    arr = np.array(sizes)
    bins = P.best_fit_decreasing(arr, 30)
    assert np.bincount(bins, arr).max() <= 30
    optimum = best(sizes, 30)
    assert P.lower_bound(P.bound_sums(arr, 30)) <= optimum <= bins.max() + 1


def test_dual_feasible_functions_beat_the_sum():
    assert P.lower_bound(P.bound_sums(np.array([60] * 10), 100)) == 10
    assert P.lower_bound(P.bound_sums(np.array([40] * 10), 100)) == 5


def tables(spark, texts):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, tokens long, pack string")
    limits = spark.createDataFrame([("pack_small", 64), ("pack_large", 200), ("summary", 9), ("pack_none", 0)], "limit_name string, max_size int")
    return docs, limits


@pytest.mark.parametrize("part_items", [20_000, 40])
def test_every_token_once(spark, part_items):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["sea", "land", "sky", "水", "été"], k=rng.choice([1, 5, 20, 60, 90, 400]))) for _ in range(200)] + [None, "", "<|endoftext|>"]
    docs, limits = tables(spark, texts)
    packed = P.pack(docs, limits, part_items=part_items)
    rows = packed.toPandas()
    size = rows.token_end - rows.token_begin
    assert (size.groupby([rows["pack"], rows["part"], rows["bin"]]).sum() <= rows.groupby(["pack", "part", "bin"]).capacity.first()).all()
    counts = {r.doc_id: r.tokens for r in P.token_counts(docs).collect()}
    assert 200 not in counts and 201 not in counts and counts[202] > 1
    for name, capacity in (("pack_small", 64), ("pack_large", 200)):
        mine = rows[rows["pack"] == name]
        assert size[mine.index].groupby(mine.doc_id).sum().to_dict() == counts
        assert all(n == math.ceil(counts[d] / capacity) for d, n in mine.groupby("doc_id").size().items())
    proof = {r["pack"]: r for r in P.certificate(packed).collect()}
    for r in proof.values():
        assert r.containers >= r.bound and r.gap == r.containers - r.bound
        assert r.containers == rows[rows["pack"] == r["pack"]].groupby(["part", "bin"]).ngroups


def test_empty(spark):
    docs, limits = tables(spark, ["a"])
    assert P.pack(docs.limit(0), limits).count() == 0 and P.pack(docs, limits.limit(0)).count() == 0


def test_no_pack_is_left_out(spark):
    limits = spark.createDataFrame([(f"pack_{i:03d}", 100 + i) for i in range(130)], "limit_name string, max_size int")
    assert len(P.capacities(limits)) == 130
