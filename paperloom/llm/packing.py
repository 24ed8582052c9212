"""Documents packed into containers of fixed token capacity, with certified bin counts.

Sizes are token counts of one public tokenizer. A text above the capacity is split into full containers and a rest;
every other text stays whole. The items are dealt by hash into partitions of about ``PART_ITEMS`` items; each partition
runs best-fit decreasing, and dual-feasible functions give a lower bound for its bins. A partition whose count equals
the bound is certified. The others exchange their items (dealt anew, together with one certified partition when only one
is left) and run again, at most ``ROUNDS`` times; a partition's new packing is kept only if the bins of the exchange get
fewer. The sums of the functions add up over partitions, so the same bounds certify the whole.

Defined results: null and empty texts and texts without tokens need no room and are not assigned; a repeated doc_id is
packed once; ties go to the lower id; a capacity that is missing or not positive packs nothing.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage, spread

from .frames import plain

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PART_ITEMS = 20_000
ROUNDS = 2
#: Parameters of the dual-feasible functions.
STEPS = (1, 2, 3, 4, 5, 6, 8, 10, 15, 20)
SHARES = (0.1, 0.2, 0.25, 0.3, 1 / 3, 0.4, 0.45, 0.5)


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of the documents that have any."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(tokenizer)
        for frame in frames:
            texts = frame["text"].tolist()
            counts = [len(e) for at in range(0, len(texts), 500) for e in t.encode_batch(texts[at : at + 500], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "tokens": counts})

    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    return spread(texts).mapInPandas(plain(run), "doc_id long, tokens long").where("tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def bound_sums(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The sum of every dual-feasible function over the sizes, in containers."""
    x = sizes.astype(float)
    out = [x.sum() / capacity]
    for k in STEPS:
        scaled = sizes * (k + 1)
        out.append(np.where(scaled % capacity == 0, x / capacity, (scaled // capacity) / k).sum())
    for share in SHARES:
        small = share * capacity
        out.append(np.where(x > capacity - small, 1.0, np.where(x < small, 0.0, x / capacity)).sum())
    return np.array(out)


def lower_bound(sums: np.ndarray) -> int:
    return int(math.ceil(sums.max() - 1e-6)) if len(sums) else 0


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of every item; items in falling size go where the least room stays."""
    order = np.argsort(-sizes, kind="stable")
    rooms: list[int] = []  # distinct rooms, sorted
    by_room: dict[int, list[int]] = {}
    out = np.zeros(len(sizes), np.int64)
    bins = 0
    for i in order:
        s = int(sizes[i])
        at = bisect_left(rooms, s)
        if at == len(rooms):
            b, room = bins, capacity
            bins += 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        out[i] = b
        left = room - s
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True])
    sizes, capacity = pdf["size"].to_numpy(np.int64), int(pdf["capacity"].iloc[0])
    pdf["bin"] = best_fit_decreasing(sizes, capacity)
    pdf["part_bins"] = int(pdf["bin"].max()) + 1
    pdf["part_bound"] = lower_bound(bound_sums(sizes, capacity))
    return pdf


_ITEM = "pack string, capacity long, part long, doc_id long, piece_no long, tokens long, size long"
_PACKED = _ITEM + ", bin long, part_bins long, part_bound long"


def capacities(size_limits: DataFrame) -> dict[str, int]:
    """Capacity of every pack of the limits table (a configuration, one row per pack name comes to the driver); none is left out."""
    rows = size_limits.where(F.col("limit_name").startswith("pack_") & (F.col("max_size") > 0)).groupBy("limit_name").agg(F.min("max_size")).collect()
    return {r[0]: int(r[1]) for r in rows}


def items(counts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(pack, capacity, doc_id, piece_no, tokens, size): one row per piece."""
    packs = F.explode(F.array(*(F.struct(F.lit(n).alias("pack"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(sizes.items()))))
    out = counts.withColumn("p", packs).select("p.*", "doc_id", "tokens")
    out = out.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(tokens - 1) div capacity"))))
    return out.withColumn("size", F.least("capacity", F.col("tokens") - F.col("piece_no") * F.col("capacity")))


def pack(documents: DataFrame, size_limits: DataFrame, tokenizer: str = TOKENIZER, part_items: int = PART_ITEMS) -> DataFrame:
    """(pack, doc_id, piece_no, token_begin, token_end, part, bin, part_bins, part_bound); (pack, part, bin) names a container."""
    sizes = capacities(size_limits)
    if not sizes:
        return documents.sparkSession.createDataFrame([], "pack string, capacity long, doc_id long, piece_no long, token_begin long, token_end long, part long, bin long, part_bins long, part_bound long")
    counts = cut_lineage(token_counts(documents, tokenizer))
    parts = max(1, math.ceil(counts.count() / part_items))
    dealt = items(counts, sizes).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)))
    packed = cut_lineage(dealt.groupBy("pack", "part").applyInPandas(_pack, _PACKED))
    for turn in range(1, ROUNDS + 1):
        state = packed.groupBy("pack", "part").agg(F.first("part_bins").alias("bins"), F.first("part_bound").alias("bound"), F.count("*").alias("n"))
        open_parts = state.where("bins > bound")
        per_pack = {r[0]: r[1] for r in open_parts.groupBy("pack").count().collect()}
        if not per_pack or (parts == 1):
            break
        lone = [p for p, n in per_pack.items() if n == 1]
        partner = state.where(F.col("pack").isin(lone) & (F.col("bins") <= F.col("bound"))).groupBy("pack").agg(F.min("part").alias("part"))
        chosen = open_parts.select("pack", "part").unionByName(partner.select("pack", "part"))
        again = packed.join(F.broadcast(chosen) if parts * len(sizes) < 100_000 else chosen, ["pack", "part"], "left_semi")
        deal = F.create_map(*(F.lit(v) for p in per_pack for v in (p, max(1, math.ceil(max(2, per_pack[p]) / 2)))))
        fresh = again.withColumn("part", F.lit(turn * parts) + F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(turn)), deal[F.col("pack")]))
        fresh = cut_lineage(fresh.select(*(c.split()[0] for c in _ITEM.split(", "))).groupBy("pack", "part").applyInPandas(_pack, _PACKED))
        before = {r[0]: r[1] for r in state.join(chosen, ["pack", "part"]).groupBy("pack").agg(F.sum("bins")).collect()}
        after = {r[0]: r[1] for r in fresh.select("pack", "part", "part_bins").distinct().groupBy("pack").agg(F.sum("part_bins")).collect()}
        better = [p for p in after if after[p] < before[p]]
        if not better:
            break
        kept = packed.join(chosen.where(F.col("pack").isin(better)), ["pack", "part"], "left_anti")
        packed = cut_lineage(kept.unionByName(fresh.where(F.col("pack").isin(better))))
    begin = F.col("piece_no") * F.col("capacity")
    return packed.select("pack", "capacity", "doc_id", "piece_no", begin.alias("token_begin"), (begin + F.col("size")).alias("token_end"), "part", "bin", "part_bins", "part_bound")


def certificate(packed: DataFrame) -> DataFrame:
    """Per pack: containers used, the lower bound of the whole, tokens, fill and gap."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (name, capacity), rows in frame.groupby(["pack", "capacity"]):
                size = (rows["token_end"] - rows["token_begin"]).to_numpy(np.int64)
                for no, value in enumerate(bound_sums(size, int(capacity))):
                    yield pd.DataFrame({"pack": [name], "function": [no], "value": [value]})

    bound = packed.select("pack", "capacity", "token_begin", "token_end").mapInPandas(plain(sums), "pack string, function int, value double")
    bound = bound.groupBy("pack", "function").agg(F.sum("value").alias("value")).groupBy("pack").agg(F.ceil(F.max("value") - 1e-6).alias("bound"))
    used = packed.groupBy("pack", "part").agg(F.first("part_bins").alias("bins"), F.first("part_bound").alias("part_bound"), F.sum(F.col("token_end") - F.col("token_begin")).alias("tokens"), F.first("capacity").alias("capacity"))
    total = used.groupBy("pack").agg(F.first("capacity").alias("capacity"), F.sum("bins").alias("containers"), F.sum("tokens").alias("tokens"), F.count("*").alias("parts"), F.sum((F.col("bins") == F.col("part_bound")).cast("long")).alias("certified_parts"))
    return total.join(bound, "pack").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity"))).withColumn("gap", F.col("containers") - F.col("bound"))
