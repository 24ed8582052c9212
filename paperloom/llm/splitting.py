"""Oversized section texts cut into overlapping pieces at natural boundaries, by lexical cohesion.

At every boundary of a paragraph, sentence or line of the whole text the words in a block before it and in a block after
it are compared (cosine of counts). A boundary where the similarity is lower than on both sides is a valley, and its
depth is the sum of the two climbs. For each piece the window of admissible ends is looked at, and the boundary with the
deepest valley is taken; the kind of mark only decides between equal depths. A window without any such boundary is
searched for clauses, then spaces, then any character. The next piece begins ``overlap`` characters before that end, so
consecutive pieces share exactly that many.

Defined results: a text within the limit, null or empty gives no piece; repeated leaf rows and pages count once;
missing pages are left out; ``end_page`` beyond the last page ends there; a limit that is missing from ``size_limits``
cuts nothing. Characters are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .conversations import clean_id
from .frames import plain

BLOCK = 240
_KINDS = [
    re.compile(r"\n\s*\n\s*"),
    re.compile(r"[.!?…][\"”’')\]]*\s+|[。！？][”’」』）]*\s*"),
    re.compile(r"\n+"),
    re.compile(r"[,;:]\s+|[，；、：]\s*|\s[–—-]\s"),
    re.compile(r"\s+"),
]
#: So many kinds are boundaries of their own; the others serve where there are none.
NATURAL = 3
_WORD = re.compile(r"[一-鿿]|[^\W_]+")


def _similarity(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


class Cohesion:
    """Block similarity at positions of one text."""

    def __init__(self, text: str) -> None:
        self.starts, self.words = [], []
        for m in _WORD.finditer(text.lower() if len(text.lower()) == len(text) else text):
            self.starts.append(m.start())
            self.words.append(m.group())

    def at(self, position: int) -> float:
        lo, mid, hi = bisect_left(self.starts, position - BLOCK), bisect_left(self.starts, position), bisect_right(self.starts, position + BLOCK)
        return _similarity(Counter(self.words[lo:mid]), Counter(self.words[mid:hi]))


def depths(values: list[float]) -> list[float]:
    """Depth of the valley at each place: climb to the highest value reached without a descent on either side."""
    out = []
    for i, v in enumerate(values):
        left = right = v
        for j in range(i - 1, -1, -1):
            if values[j] < left:
                break
            left = values[j]
        for j in range(i + 1, len(values)):
            if values[j] < right:
                break
            right = values[j]
        out.append(left - v + right - v)
    return out


def cut(text: str | None, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the pieces; empty if the text is within the limit."""
    if not text or limit <= 0 or len(text) <= limit:
        return []
    overlap = max(0, min(overlap, limit - 1))
    cohesion = Cohesion(text)
    kinds = {}
    for rank, kind in enumerate(_KINDS[:NATURAL]):
        for m in kind.finditer(text):
            kinds.setdefault(m.end(), rank)
    natural = sorted(kinds)
    depth = dict(zip(natural, depths([cohesion.at(p) for p in natural])))
    lesser = [[m.end() for m in kind.finditer(text)] for kind in _KINDS[NATURAL:]]
    pieces, begin = [], 0
    while len(text) - begin > limit:
        low, high = begin + max(overlap + 1, limit // 2), begin + limit
        places = natural[bisect_left(natural, low) : bisect_right(natural, high)]
        if places:
            end = max(places, key=lambda p: (round(depth[p], 9), -kinds[p], p))
        else:
            for ends in lesser:
                places = ends[bisect_left(ends, low) : bisect_right(ends, high)]
                if places:
                    break
            else:
                places = list(range(low, high + 1, max(1, limit // 40)))
            scores = depths([cohesion.at(p) for p in places])
            end = places[max(range(len(places)), key=lambda i: (round(scores[i], 9), places[i]))]
        pieces.append((begin, end))
        begin = end - overlap
    pieces.append((begin, len(text)))
    return pieces


def limits(size_limits: DataFrame, names: tuple[str, ...]) -> dict[str, tuple[int, int]]:
    """(max_size, overlap_size) of the named limits; at most one row per name is collected."""
    rows = size_limits.where(F.col("limit_name").isin(*names)).groupBy("limit_name").agg(F.min("max_size"), F.min(F.coalesce("overlap_size", F.lit(0)))).collect()
    return {r[0]: (int(r[1]), int(r[2])) for r in rows if r[1] is not None}


def distinct_leaves(leaves: DataFrame) -> DataFrame:
    """One row per (paper_id, leaf_no)."""
    kept = F.max(F.struct(F.length("summary").alias("n"), "summary", "start_page", "end_page")).alias("row")
    return leaves.withColumn("paper_id", clean_id("paper_id")).where("paper_id is not null and leaf_no is not null").groupBy("paper_id", "leaf_no").agg(kept).select("paper_id", "leaf_no", "row.summary", "row.start_page", "row.end_page")


def page_texts(leaves: DataFrame, pages: DataFrame, limit: int) -> DataFrame:
    """(paper_id, leaf_no, text) of the leaves whose joined pages exceed ``limit``; an equi-join on page numbers, so that a paper with many leaves stays linear."""
    pages = pages.withColumn("paper_id", clean_id("paper_id"))
    once = pages.where("paper_id is not null and page_no is not null").groupBy("paper_id", "page_no").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    last = pages.groupBy("paper_id").agg(F.max("page_no").alias("last"), F.min("page_no").alias("first"))
    wanted = (
        leaves.join(last, "paper_id")
        .select("paper_id", "leaf_no", F.greatest("start_page", "first").alias("a"), F.least("end_page", "last").alias("b"))
        .where("a <= b")
        .select("paper_id", "leaf_no", F.explode(F.sequence("a", "b")).alias("page_no"))
    )
    sizes = once.select("paper_id", "page_no", F.length("text").alias("n"))
    over = wanted.join(sizes, ["paper_id", "page_no"]).groupBy("paper_id", "leaf_no").agg((F.sum("n") + 2 * (F.count("*") - 1)).alias("chars")).where(F.col("chars") > limit)
    texts = wanted.join(over.select("paper_id", "leaf_no"), ["paper_id", "leaf_no"], "left_semi").join(once, ["paper_id", "page_no"])
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return texts.groupBy("paper_id", "leaf_no").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def pieces(leaves: DataFrame, pages: DataFrame, size_limits: DataFrame) -> DataFrame:
    """(paper_id, leaf_no, field, piece_no, begin, end, text) of every oversized summary and page range."""
    allowed = limits(size_limits, ("summary", "pages"))
    kept = distinct_leaves(leaves)
    schema = "paper_id string, leaf_no int, field string, piece_no int, begin int, end int, text string"
    parts = []
    if "summary" in allowed:
        parts.append(kept.where(F.length("summary") > allowed["summary"][0]).select("paper_id", "leaf_no", F.lit("summary").alias("field"), F.col("summary").alias("text")))
    if "pages" in allowed:
        parts.append(page_texts(kept, pages, allowed["pages"][0]).select("paper_id", "leaf_no", F.lit("pages").alias("field"), "text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (paper, leaf, field, no, begin, end, text[begin:end])
                for paper, leaf, field, text in zip(frame["paper_id"], frame["leaf_no"], frame["field"], frame["text"])
                for no, (begin, end) in enumerate(cut(text, *allowed[field]))
            ]
            yield pd.DataFrame(rows, columns=["paper_id", "leaf_no", "field", "piece_no", "begin", "end", "text"])

    if not parts:
        return kept.sparkSession.createDataFrame([], schema)
    oversized = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return oversized.mapInPandas(plain(run), schema)


def found(leaves: DataFrame, pages: DataFrame, size_limits: DataFrame) -> DataFrame:
    return pieces(leaves, pages, size_limits).select("paper_id", "leaf_no", "field").distinct()
