"""Evaluation passages inside a training corpus, by spaced-seed hashing.

A *track* fixes the units in which a test item is read: ``words`` (runs of letters or digits) for items in languages
with word spaces, ``chars`` (single letters or digits, everything else removed) for Chinese items. Every window of
``span`` units of an item is hashed under several fixed masks, each of which ignores some of the positions; every
window of every document is hashed in the same way. A bit filter of fixed size, built from the test hashes, keeps
nearly all document windows from leaving the scan; the rest meet the test hashes in an equi-join, and each hit is
verified on its diagonal, where substituted units may interrupt the overlap.

A window carries the hash of all its units beside the seed; a hit whose windows agree in full is an exact overlap of a
span, and that is all ``found`` needs: no text leaves the scan. ``leaked_items`` also measures the overlaps around every
hit, with substitutions; for that the texts of documents with hits, and of no others, meet the hits in a second scan.

Size of what travels: a bit filter has at most ``FILTER_WORDS`` long integers, sized from the number of test seeds (or of
hit documents) so that about one bit in ``SPARSE`` is set; beyond that bound it lets more rows pass and loses none. Test
hashes are joined as a table, ``SALTS`` times, so that a passage that a third of all documents hold is no single task.

Defined results: a null, empty or unit-less text (of a document or an item) matches nothing; an item shorter than the
span cannot leak; a repeated passage counts once per (document, item); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage, spread

from .frames import plain

#: Kept positions per mask; all masks span the least overlap that counts.
WORD_MASKS = ("110110110111", "111010011101", "101111001011")
CHAR_MASKS = ("110110110110110110110111", "111010011101111010011101", "101111001011101111001011")
TRACKS = {"words": WORD_MASKS, "chars": CHAR_MASKS}
#: Bound of a bit filter in long integers, and its bits for every bit set.
FILTER_WORDS, SPARSE = 1 << 21, 64
SALTS = 8
#: Texts hashed together.
CHUNK = 256
_UNIT = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(values: np.ndarray) -> np.ndarray:
    x = values * _ODD
    x ^= x >> np.uint64(32)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def _word_hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


_known_word = lru_cache(1 << 17)(_word_hash)


def flat_units(texts: list[str | None], track: str) -> tuple[np.ndarray, np.ndarray]:
    """(units of all texts one after another as 64-bit numbers, number of units of each)."""
    runs = [_UNIT.findall((t or "").lower()) for t in texts]
    if track == "words":
        return np.array([_known_word(w) for r in runs for w in r], np.uint64), np.array([len(r) for r in runs], np.int64)
    joined = ["".join(r) for r in runs]
    return np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.array([len(j) for j in joined], np.int64)


def units(text: str | None, track: str) -> np.ndarray:
    """The units of a text as 64-bit numbers."""
    return flat_units([text], track)[0]


def seeds(numbers: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """For every mask the hash of the window that begins at each position."""
    span = len(masks[0])
    n = len(numbers) - span + 1
    if n <= 0:
        return [np.zeros(0, np.uint64) for _ in masks]
    with np.errstate(over="ignore"):
        mixed = _mix(numbers + np.uint64(1))
        out = []
        for at, mask in enumerate(masks):
            total = np.full(n, np.uint64(at + 1) * _MIX)
            for j, bit in enumerate(mask):
                if bit == "1":
                    total = total * _ODD + mixed[j : j + n]
            out.append(_mix(total))
    return out


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits set."""
    wide = np.uint64(len(bits).bit_length() + 5)
    keep = np.ones(len(hashes), bool)
    for part in (hashes >> (np.uint64(64) - wide), (hashes >> np.uint64(4)) & ((np.uint64(1) << wide) - np.uint64(1))):
        keep &= (bits[(part >> np.uint64(6)).astype(np.int64)] >> (part & np.uint64(63))) & np.uint64(1) == 1
    return keep


_SEED = "track string, seed long, whole long, place long"


def _seed_frame(ids: np.ndarray, texts: list[str | None], key: str, track: str, bits: np.ndarray | None) -> pd.DataFrame:
    """(key, track, seed, whole, place) of all windows of some texts, those that pass the filter if there is one."""
    masks = TRACKS[track]
    span = len(masks[0])
    numbers, lengths = flat_units(texts, track)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes = seeds(numbers, ("1" * span, *masks))
    inside = np.flatnonzero(owner[: len(hashes[0])] == owner[span - 1 :]) if len(hashes[0]) else np.zeros(0, np.int64)
    parts = []
    for h in hashes[1:]:
        at = inside if bits is None else inside[_passes(bits, h[inside])]
        parts.append(pd.DataFrame({key: ids[owner[at]], "seed": h[at].view(np.int64), "whole": hashes[0][at].view(np.int64), "place": at - first[at]}))
    out = pd.concat(parts, ignore_index=True)
    out.insert(1, "track", track)
    return out


def test_seeds(items: DataFrame) -> DataFrame:
    """(item_id, track, seed, whole, place) of every window of every item."""
    named = items.select(F.col("item_id").cast("long"), "text", F.when(F.lower(F.col("lang")).startswith("zh"), "chars").otherwise("words").alias("track")).where("item_id is not null and text is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for track, part in frame.groupby("track"):
                for at in range(0, len(part), CHUNK):
                    yield _seed_frame(part["item_id"].to_numpy()[at : at + CHUNK], part["text"].tolist()[at : at + CHUNK], "item_id", track, None)

    return named.mapInPandas(plain(run), "item_id long, " + _SEED)


def filter_bits(hashes: DataFrame, name: str = "track", hashed: str = "seed") -> dict[str, np.ndarray]:
    """Per name two bits for each hash; the collected rows are bounded by names times FILTER_WORDS."""
    out = {}
    for track, n in ((r[0], r[1]) for r in hashes.groupBy(name).agg(F.approx_count_distinct(hashed)).collect()):
        words = min(FILTER_WORDS, max(1 << 10, 1 << (2 * n * SPARSE // 64).bit_length()))
        wide = words.bit_length() + 5
        part = F.explode(F.array(F.shiftrightunsigned(hashed, 64 - wide), F.shiftrightunsigned(hashed, 4).bitwiseAND(F.lit((1 << wide) - 1))))
        rows = (
            hashes.where(F.col(name) == track)
            .select(part.alias("bit"))
            .groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
            .toPandas()
        )
        filled = np.zeros(words, np.int64)
        filled[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
        out[track] = filled.view(np.uint64)
    return out


def longest_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, slack: int) -> tuple[int, int, int]:
    """On one diagonal: the longest exact run, and (matched units, length) of the longest stretch whose mismatches lie at least ``slack`` apart."""
    first = max(0, diagonal)
    last = min(len(doc), diagonal + len(item))
    same = doc[first:last] == item[first - diagonal : last - diagonal]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return 0, 0, 0
    runs = ends - starts
    best = (0, 0)
    matched, begin, end = int(runs[0]), int(starts[0]), int(ends[0])
    for s, e in zip(starts[1:], ends[1:]):
        if s - end == 1 and e - s >= slack:
            matched += int(e - s)
        else:
            best = max(best, (matched, end - begin))
            matched, begin = int(e - s), int(s)
        end = int(e)
    best = max(best, (matched, end - begin))
    return int(runs.max()), best[0], best[1]


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for doc_id, item_id, track, text, item_text, diagonals in zip(*(frame[c] for c in ("doc_id", "item_id", "track", "text", "item_text", "diagonals"))):
            doc, item = units(text, track), units(item_text, track)
            span = len(TRACKS[track][0])
            found = [longest_overlap(doc, item, int(d), span // 4) for d in diagonals]
            run = max(x[0] for x in found)
            matched, length = max((x[1], x[2]) for x in found)
            out.append((doc_id, item_id, track, run, matched, length, run >= span))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "track", "exact_run", "matched", "overlap", "leaked"])


def _needs_han(items: DataFrame) -> bool:
    """Whether every window of the character items holds a Chinese character, so that texts without any can be passed over."""
    bare = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    span = len(CHAR_MASKS[0])
    other = items.where(F.lower("lang").startswith("zh")).where(bare.rlike(f"[^一-鿿]{{{span}}}"))
    return other.limit(1).count() == 0


def hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, track, diagonal, exact) of every window of a document that shares a seed with one of an item; ``exact``: in all units."""
    tests = cut_lineage(test_seeds(items))
    bits = filter_bits(tests)
    han_only = _needs_han(items)
    texts = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                chunk = frame.iloc[at : at + CHUNK]
                for track, filled in bits.items():
                    part = chunk[chunk["text"].str.contains("[一-鿿]")] if track == "chars" and han_only else chunk
                    if len(part):
                        yield _seed_frame(part["doc_id"].to_numpy(), part["text"].tolist(), "doc_id", track, filled)

    windows = spread(texts).mapInPandas(plain(scan), "doc_id long, " + _SEED).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salted = tests.select("item_id", "track", "seed", F.col("whole").alias("item_whole"), F.col("place").alias("item_place"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = windows.join(salted.hint("merge"), ["track", "seed", "salt"])
    return met.select("doc_id", "item_id", "track", (F.col("place") - F.col("item_place")).alias("diagonal"), (F.col("whole") == F.col("item_whole")).alias("exact"))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every (document, item) with a seed hit: longest exact run, substitution-tolerant overlap, and whether the exact run reaches the span."""
    per = cut_lineage(hits(documents, items).select("doc_id", "item_id", "track", "diagonal").distinct().groupBy("doc_id", "item_id", "track").agg(F.collect_list("diagonal").alias("diagonals")))
    marked = per.select(F.lit("doc").alias("name"), F.xxhash64("doc_id").alias("hash"))
    bits = filter_bits(marked, "name", "hash").get("doc")
    texts = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    if bits is not None:

        @F.pandas_udf("boolean")
        def hit(hashed: pd.Series) -> pd.Series:
            return pd.Series(_passes(bits, hashed.to_numpy(np.int64).view(np.uint64)))

        texts = texts.where(hit(F.xxhash64("doc_id")))
    with_texts = per.join(items.select(F.col("item_id").cast("long"), F.col("text").alias("item_text")), "item_id").join(texts, "doc_id")
    return with_texts.select("doc_id", "item_id", "track", "text", "item_text", "diagonals").mapInPandas(
        plain(_verify), "doc_id long, item_id long, track string, exact_run long, matched long, overlap long, leaked boolean"
    )


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the leaks: seed hits whose windows agree in all units."""
    return hits(documents, items).where("exact").select("doc_id", "item_id").distinct()
