"""Near-duplicate records by PartEnum signatures.

A record is the set of pairs of neighbouring words of its title, abstract and file name. Two records are alike if the
Jaccard similarity of their sets reaches ``threshold`` t; then their sizes a <= b lie within a factor t of each other and
they have at least o = t / (1 + t) * (a + b) elements in common.

Equal sets form one class, and only one representative of each class goes on. Representatives are held in bands of size,
[2^c, 2^(c+1)). A record signs in its own band as the larger of two, and as the smaller of two in every band in which a
larger partner may lie, so alike records always share a band. In a band the feature domain is cut by a hash into n1
parts, each part into cells as fine as single features, and the subsets of two occupied cells of a part are enumerated:
one signature each. With m = n1 + 1 elements in common some part holds two of them (pigeonhole), so alike sets share a
signature without exception, and no signature stands for empty cells, which unlike sets would share by the thousand.
Because m is smaller than o, a record enumerates only the a - o + m rarest of its elements: in one order of the domain
the first m common elements of two alike sets lie in that part of both. The order (frequency class, then hash) may be any
as long as it is the same everywhere; frequencies are counted over all records in a table of fixed size.

A signature shared by more than ``HOT`` rows is combined with those of a further, independent instance, which alike
records share as well, up to ``INSTANCES`` instances; what is still crowded then is compared in an ordinary join, which
spills and is split by the engine. Within a bucket only pairs pass whose sizes fit and whose parity sketches differ in no
more bits than the sets may differ in elements: a lower bound, so nothing alike is lost. Pairs that pass are verified
exactly.

Defined results: a record with a blank abstract takes part in nothing; null title and file name are empty; a repeated id
counts once (the row with the longest text); a record with fewer than two words has no pair of words and equals no
other; ids are compared as they stand, in lower case without outer spaces. The guarantee needs a threshold above 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.graph import components
from paperloom.session import cut_lineage

from .conversations import blank, clean_id
from .frames import plain

THRESHOLD = 0.6
#: The smallest size of a band by its number of parts.
PER_PART = 8
#: Rows of a signature beyond which a further instance refines it (its signatures cost more than comparing that many sketches), and the number of instances.
HOT, INSTANCES = 20_000, 2
#: Pairs looked at together, and pairs of a bucket from which sketches are compared as a product of matrices.
PAIRS_AT_ONCE, DENSE = 1 << 20, 1 << 12
#: Longs in the parity sketch.
SKETCH = 4
#: Counters of the frequency table.
COUNTERS = 1 << 16
SMALL, LARGE = 0, 1
_WORD = re.compile(r"[一-鿿]|(?:(?![一-鿿])[^\W_])+")


def word_pairs(text: str) -> np.ndarray:
    """The distinct pairs of neighbouring words as sorted 64-bit hashes."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall(text.lower())
    return np.unique(np.fromiter((xxh64_intdigest(f"{a}\x00{b}") for a, b in zip(words, words[1:])), np.uint64, max(0, len(words) - 1)))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """A byte for every counter that grows with its logarithm."""
    return np.minimum(np.floor(6 * np.log2(counts + 1.0)), 255).astype(np.uint8)


def parts_of(band: np.ndarray) -> np.ndarray:
    """n1 of a band [2^band, 2^(band + 1))."""
    return np.maximum(1, (1 << np.asarray(band, np.int64)) // PER_PART)


def roles(sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, role, band) of all bands in which sets of these sizes sign."""
    own = np.floor(np.log2(sizes)).astype(np.int64)
    every = np.arange(len(sizes))
    up = np.flatnonzero(threshold * (2 << own) <= sizes + 1e-9)
    at = np.concatenate((every, every, every[up]))
    role = np.repeat([LARGE, SMALL, SMALL], [len(every), len(every), len(up)])
    return at, role, np.concatenate((own, own, own[up] + 1))


def ordered(sets: list[np.ndarray], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, starts, sizes): the sets one after another, each with its rarest features first."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = flat[np.lexsort((flat, classes[(flat % np.uint64(len(classes))).astype(np.int64)], owner))]
    return flat, np.cumsum(sizes) - sizes, sizes


def signatures(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, role: np.ndarray, band: np.ndarray, threshold: float, instance: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, signature) for entries that each sign for one set, role and band."""
    parts = parts_of(band)
    partner = np.where(role == LARGE, threshold * sizes, np.maximum(sizes, 1 << band))
    common = np.ceil(threshold / (1 + threshold) * (sizes + partner) - 1e-9).astype(np.int64)
    length = np.minimum(sizes, sizes - common + parts + 1)
    entry = np.repeat(np.arange(len(sizes)), length)
    features = flat[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(len(entry))]
    with np.errstate(over="ignore"):
        part = _mix(features, 2 * instance) % parts[entry].astype(np.uint64)
        value = _mix(features, 2 * instance + 1)
        group = entry * (int(parts.max(initial=1)) + 1) + part.astype(np.int64)
        order = np.lexsort((value, group))
        group, value, entry = group[order], value[order], entry[order]
        salt = _mix(band.astype(np.uint64), 77 + instance)
        found_entry, found = [], []
        step, at = 1, np.arange(len(group))
        while len(at):
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]
            found_entry.append(entry[at])
            found.append(_mix((value[at] * np.uint64(0x9E3779B97F4A7C15) + value[at + step]) ^ salt[entry[at]], 99))
            step += 1
    return np.concatenate(found_entry or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.uint64)])


def sketch(features: np.ndarray) -> np.ndarray:
    """Parities of the features by bucket: sketches differ in no more bits than the sets in elements."""
    place = (features >> np.uint64(7)) % np.uint64(64 * SKETCH)
    odd = (np.bincount(place.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint64)
    return (odd.reshape(SKETCH, 64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def records(papers: DataFrame) -> DataFrame:
    """(id, text) of every id with a non-blank abstract."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "abstract", "file_name")))
    kept = papers.where(F.col("id").isNotNull() & ~blank("abstract")).select(clean_id("id").alias("id"), text.alias("text"))
    return kept.groupBy("id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("m")).select("id", "m.text")


def featured(texts: DataFrame) -> DataFrame:
    """(id, class, size, features, sketch columns); ``class`` is a 64-bit digest of the set."""
    from xxhash import xxh3_64_intdigest

    schema = "id string, class long, size int, features binary, " + ", ".join(f"s{i} long" for i in range(SKETCH))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [word_pairs(t) for t in frame["text"]]
            marks = np.array([sketch(s) for s in sets]).reshape(-1, SKETCH)
            digests = np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "class": digests, "size": [len(s) for s in sets], "features": [s.tobytes() for s in sets]} | {f"s{i}": marks[:, i] for i in range(SKETCH)})

    return texts.mapInPandas(plain(run), schema).where("size > 0")


_MARKS = [f"s{i}" for i in range(SKETCH)]
_ROW = "sig long, role byte, band byte, class long, size int, " + ", ".join(f"{m} long" for m in _MARKS)


def feature_classes(reps: DataFrame) -> np.ndarray:
    """Frequency classes over all representatives; at most ``COUNTERS`` sums are collected."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for frame in frames:
            for at in range(0, len(frame), 4096):
                flat = np.frombuffer(b"".join(frame["features"].iloc[at : at + 4096]), np.uint64)
                total += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"counter": at, "n": total[at]})

    summed = reps.select("features").mapInPandas(plain(count), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[summed["counter"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return frequency_classes(counts)


def _signed(rows: DataFrame, threshold: float, instance: int, classes: np.ndarray) -> DataFrame:
    """The signatures of every representative, or, from the second instance on, of rows (sig, role, band, ...) with their features, combined with the signature they have."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), 256):
                chunk = frame.iloc[begin : begin + 256]
                flat, starts, sizes = ordered([np.frombuffer(f, np.uint64) for f in chunk["features"]], classes)
                if instance:
                    at, role, band = np.arange(len(chunk)), chunk["role"].to_numpy(np.int64), chunk["band"].to_numpy(np.int64)
                else:
                    at, role, band = roles(sizes, threshold)
                entry, sig = signatures(flat, starts[at], sizes[at], role, band, threshold, instance)
                row = at[entry]
                if instance:
                    with np.errstate(over="ignore"):
                        sig = _mix(sig + _mix(chunk["sig"].to_numpy(np.int64).view(np.uint64), 55)[row], 56)
                yield pd.DataFrame({"sig": sig.view(np.int64), "role": role[entry].astype(np.int8), "band": band[entry].astype(np.int8)} | {c: chunk[c].to_numpy()[row] for c in ("class", "size", *_MARKS)})

    kept = [*(("sig", "role", "band") if instance else ()), "features", "class", "size", *_MARKS]
    return rows.select(*kept).mapInPandas(plain(run), _ROW)


def _compare(columns: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(class_a, class_b) of rows sorted by signature that meet as smaller and larger and pass the size and sketch bounds."""
    factor = (1 - threshold) / (1 + threshold)
    sig, size, ids = columns["sig"], columns["size"], columns["class"]
    edges = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
    smaller = np.add.reduceat((columns["role"] == SMALL).astype(np.int64), edges[:-1])
    larger = np.diff(edges) - smaller
    both = np.flatnonzero((smaller > 0) & (larger > 0))
    first, smaller, larger = edges[:-1][both], smaller[both], larger[both]
    out_a, out_b = [], []
    dense = smaller * larger > DENSE
    for at, n, more in zip(first[dense], smaller[dense], larger[dense]):
        bits = np.ascontiguousarray(np.stack([columns[m][at : at + n + more] for m in _MARKS], 1)).view(np.uint8)
        signs = np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1
        for lo in range(at, at + n, 1024):
            for low in range(at + n, at + n + more, 1024):
                x, y = slice(lo, min(lo + 1024, at + n)), slice(low, min(low + 1024, at + n + more))
                apart = (64 * SKETCH - signs[x.start - at : x.stop - at] @ signs[y.start - at : y.stop - at].T) / 2
                r, c = np.nonzero(apart <= factor * (size[x].astype(np.float32)[:, None] + size[y].astype(np.float32)[None, :]) + 1e-3)
                r, c = r + lo, c + low
                fits = (size[r] >= threshold * size[c]) & ((size[r] < size[c]) | ((size[r] == size[c]) & (ids[r] < ids[c])))
                out_a.append(ids[r[fits]])
                out_b.append(ids[c[fits]])
    first, smaller, larger = first[~dense], smaller[~dense], larger[~dense]
    block = np.cumsum(smaller * larger) // PAIRS_AT_ONCE
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else []
    for lo, hi in zip(cuts, cuts[1:]):
        n = smaller[lo:hi] * larger[lo:hi]
        of = np.repeat(np.arange(lo, hi), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        x, y = first[of] + k // larger[of], first[of] + smaller[of] + k % larger[of]
        fits = (size[x] >= threshold * size[y]) & ((size[x] < size[y]) | ((size[x] == size[y]) & (ids[x] < ids[y])))
        x, y = x[fits], y[fits]
        apart = np.zeros(len(x), np.int64)
        for m in _MARKS:
            apart += np.bitwise_count((columns[m][x] ^ columns[m][y]).view(np.uint64))  # of a negative number the bits of its amount would count
        near = apart <= factor * (size[x] + size[y]) + 1e-9
        out_a.append(ids[x[near]])
        out_b.append(ids[y[near]])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_a or none), np.concatenate(out_b or none)


def _meetings(threshold: float, hot: int):
    """For rows sorted by signature and role: the pairs that meet (``other`` set); rows of a signature with more than ``hot`` of them come out alone. At most a batch and ``hot`` rows are held."""
    names = [c.split()[0] for c in _ROW.split(", ")]

    def lone(columns: dict[str, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame(columns | {"other": pd.array([None] * len(columns["sig"]), dtype="Int64")})

    def judged(columns: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        sig = columns["sig"]
        if not len(sig):
            return
        group = np.concatenate(([0], np.cumsum(sig[1:] != sig[:-1])))
        crowded = np.bincount(group)[group] > hot
        if crowded.any():
            yield lone({c: v[crowded] for c, v in columns.items()})
            columns = {c: v[~crowded] for c, v in columns.items()}
        if len(columns["sig"]):
            a, b = _compare(columns, threshold)
            if len(a):
                met = pd.DataFrame({"class": a, "other": b}).drop_duplicates()
                yield pd.DataFrame({c: met["class"] if c == "class" else np.zeros(len(met), np.int64) for c in names} | {"other": met["other"].astype("Int64")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []
        rows, flooded = 0, None
        for frame in frames:
            columns = {c: frame[c].to_numpy() for c in names}
            if flooded is not None:
                same = columns["sig"] == flooded
                if same.any():
                    yield lone({c: v[same] for c, v in columns.items()})
                    columns = {c: v[~same] for c, v in columns.items()}
                if not len(columns["sig"]):
                    continue
                flooded = None
            held.append(columns)
            rows += len(columns["sig"])
            if rows < 60_000:
                continue
            whole = {c: np.concatenate([h[c] for h in held]) for c in names}
            last = whole["sig"][-1]
            open_from = int(np.argmax(whole["sig"] == last))  # the last signature may go on in the next batch
            yield from judged({c: v[:open_from] for c, v in whole.items()})
            rest = {c: v[open_from:] for c, v in whole.items()}
            if rows - open_from > hot:
                yield lone(rest)
                held, rows, flooded = [], 0, last
            else:
                held, rows = [rest], rows - open_from
        if held:
            yield from judged({c: np.concatenate([h[c] for h in held]) for c in names})

    return run


def candidates(reps: DataFrame, threshold: float, hot: int = HOT, instances: int = INSTANCES) -> DataFrame:
    """Distinct pairs (class_a, class_b) of representatives that share a signature and pass the size and sketch bounds."""
    if threshold <= 0.5:
        raise ValueError("the pigeonhole needs two common elements, so a threshold above 0.5")
    classes = feature_classes(reps)
    features = reps.select("class", "features")
    rows, found_pairs = reps, []
    for instance in range(instances):
        signed = _signed(rows, threshold, instance, classes)
        placed = signed.repartition("sig").sortWithinPartitions("sig", "role")
        met = cut_lineage(placed.mapInPandas(plain(_meetings(threshold, hot)), _ROW + ", other long"))
        found_pairs.append(met.where("other is not null").select(F.col("class").alias("class_a"), F.col("other").alias("class_b")))
        crowded = met.where("other is null").drop("other")
        if crowded.limit(1).count() == 0:
            break
        rows = crowded.join(features, "class")
    else:
        left, right = (crowded.where(F.col("role") == r).select("sig", *(F.col(c).alias(f"{c}_{r}") for c in ("class", "size", *_MARKS))) for r in (SMALL, LARGE))
        apart = sum((F.bit_count(F.col(f"{m}_0").bitwiseXOR(F.col(f"{m}_1"))) for m in _MARKS), F.lit(0))
        fits = F.expr(f"size_0 >= {threshold} * size_1 and (size_0 < size_1 or (size_0 = size_1 and class_0 < class_1))")
        joined = left.join(right, "sig").where(fits & (apart <= (1 - threshold) / (1 + threshold) * (F.col("size_0") + F.col("size_1")) + 1e-9))
        found_pairs.append(joined.select(F.col("class_0").alias("class_a"), F.col("class_1").alias("class_b")))
    out = found_pairs[0]
    for more in found_pairs[1:]:
        out = out.unionByName(more)
    return out.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct()


def alike_classes(reps: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(class_a, class_b, likeness) of the pairs of classes that reach the threshold."""

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for a, b, x, y in zip(frame["class_a"], frame["class_b"], frame["fa"], frame["fb"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                likeness = common / (len(p) + len(q) - common)
                if likeness >= threshold:
                    rows.append((a, b, likeness))
            yield pd.DataFrame(rows, columns=["class_a", "class_b", "likeness"])

    sets = reps.select("class", "features")
    pairs = candidates(reps, threshold, hot).join(sets.toDF("class_a", "fa"), "class_a").join(sets.toDF("class_b", "fb"), "class_b")
    return pairs.mapInPandas(plain(verify), "class_a long, class_b long, likeness double")


def prepared(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, representatives): ids with their class, and one row per class."""
    every = cut_lineage(featured(records(papers)))
    marks = [f"s{i}" for i in range(SKETCH)]
    reps = cut_lineage(every.groupBy("class").agg(F.first("size").alias("size"), F.first("features").alias("features"), *(F.first(m).alias(m) for m in marks)))
    return every.select("id", "class"), reps


def links(papers: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(class_a, class_b, likeness) between classes of different texts."""
    return alike_classes(prepared(papers)[1], threshold, hot)


def groups(papers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(paper_id, group_id, links): connected groups of alike records; ``links`` counts the alike classes and the copies of the own."""
    members, reps = prepared(papers)
    pairs = cut_lineage(alike_classes(reps, threshold).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    state = components(reps, pairs, "class")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    copies = members.groupBy("class").agg(F.count("*").alias("copies"))
    per = state.join(degree.withColumnRenamed("a", "class"), "class", "left").join(copies, "class")
    return members.join(per, "class").select(F.col("id").alias("paper_id"), F.col("root").alias("group_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))


def found(papers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(paper_id_a, paper_id_b) of all alike pairs of different ids, smaller id first."""
    members, reps = prepared(papers)
    pairs = alike_classes(reps, threshold).select("class_a", "class_b")
    left, right = members.toDF("x", "class_a"), members.toDF("y", "class_b")
    between = pairs.join(left, "class_a").join(right, "class_b").select("x", "y")
    several = members.groupBy("class").count().where("count > 1").select("class")
    copies = members.join(several, "class", "left_semi").select("id", "class")
    within = copies.toDF("x", "class").join(copies.toDF("y", "class"), "class").where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("paper_id_a"), F.greatest("x", "y").alias("paper_id_b")).distinct()
