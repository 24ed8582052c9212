"""Language of every record and of every stretch in another language, with a calibrated confidence.

Model: sparse multinomial logistic regression on TF-IDF weighted character n-grams (1 to 4, hashed), trained by the
follow-the-regularised-leader proximal update with L1 and L2 penalties, then calibrated by one temperature on held-out
sentences. The inverse document frequencies come from all records. The training sentences come from at most
``PER_LANGUAGE`` records for each label (those with the smallest hash of their id) and at most ``PER_RECORD`` sentences
of each, the only bounded sample here; a
first model drops sentences that contradict their record's label, since labels are noisy and records mixed.

A record is cut into sentences (code, formulas and markup aside); each sentence is classified by itself, and neighbours
in one language form a segment. Languages: see ``LANGUAGES``.

Defined results: a null or empty text, or one without letters, has no segment; sentences below ``SURE`` or with fewer
than ``LEAST`` letters (Chinese characters count four) join the language before them and decide nothing; repeated
records count once, those without an id not at all; labels outside the list name no language; without any label that
names one the model knows nothing, and confidences stay below ``SURE``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import plain

LANGUAGES = ("en", "zh", "de", "fr", "es", "ru")
#: English names and ISO codes of the languages.
NAMES = {
    "en": ("en", "eng", "english"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish", "castilian"),
    "ru": ("ru", "rus", "russian"),
}
DIM = 1 << 15
GRAMS = 4
#: Records looked at together when their n-grams are counted.
CHUNK = 32
PER_LANGUAGE = 400
PER_RECORD = 12
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 0.002
TRUST = 0.98
SURE = 0.45
LEAST = 8

_SKIP = re.compile(r"```.*?(?:```|\Z)|\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$|\$[^$\n]*\$|https?://\S+", re.S)
_CUT = re.compile(
    r"(?<=[.!?…])\s+|(?<=[.!?…][\"”»’')\]])\s+|(?<=[。！？])(?![”’」』）])|(?<=[。！？][”’」』）])|\n\s*\n|\n(?=\s*(?:[-*>•#]|\d+[.)])\s)|\n?-{3,}\n?"
    r"|(?=[“«][^“”«»]*[.!?。！？…][”»])|(?<=[.!?。！？…][”»])|\s/\s"
)
_MARK = re.compile(r"^(?:[/|>•*#–—-]+\s*|\d+[.)]\s+)+")
_LETTER = re.compile(r"[^\W\d_]")
_HAN = re.compile(r"[一-鿿]")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, without code, formulas and markup; line breaks inside a sentence are spaces."""
    if not text:
        return []
    parts = (_MARK.sub("", " ".join(p.split())) for p in _CUT.split(_SKIP.sub("\n\n", text)))
    return [p for p in parts if _LETTER.search(p)]


def weight(sentence: str) -> int:
    return len(_LETTER.findall(sentence)) + 3 * len(_HAN.findall(sentence))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram occurrence."""
    low = [" " + re.sub(r"\d+", "0", t.lower()) + " " for t in texts]
    lengths = np.fromiter((len(t) for t in low), np.int64, len(low))
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(low)), lengths)
    with np.errstate(over="ignore"):
        out_rows, out = [rows], [(codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)]
        h = codes
        for n in range(2, GRAMS + 1):
            h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            same = rows[: len(h)] == rows[n - 1 :]
            out_rows.append(rows[: len(h)][same])
            out.append(((h[same] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49))
    return np.concatenate(out_rows), np.concatenate(out).astype(np.int64)


def document_frequency(records: DataFrame) -> np.ndarray:
    """For every bucket the number of records that hold it, plus one slot for the number of records."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DIM + 1, np.int64)
        for frame in frames:
            texts = frame["text"].tolist()
            for at in range(0, len(texts), CHUNK):
                chunk = texts[at : at + CHUNK]
                rows, buckets = grams(chunk)
                present = np.zeros(len(chunk) * DIM, np.uint8)
                present[rows * DIM + buckets] = 1
                total[:DIM] += present.reshape(len(chunk), DIM).sum(0, dtype=np.int64)
            total[DIM] += len(texts)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    counted = records.where("text is not null").select("text").mapInPandas(plain(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIM + 1, np.int64)
    out[counted["bucket"]] = counted["n"]
    return out


class Model:
    """Weights per bucket and language, inverse document frequencies and the temperature."""

    def __init__(self, frequency: np.ndarray) -> None:
        self.idf = np.log((1.0 + frequency[DIM]) / (1.0 + frequency[:DIM])) + 1.0
        self.w = np.zeros((DIM, len(LANGUAGES)), np.float32)
        self.bias = np.zeros(len(LANGUAGES))
        self.temperature = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        rows, buckets = grams(texts)
        out = np.zeros((len(texts), len(LANGUAGES)))
        weighted = self.idf[buckets]
        for k in range(len(LANGUAGES)):
            out[:, k] = np.bincount(rows, weighted * self.w[buckets, k], len(texts))
        norm = np.sqrt(np.bincount(rows, weighted**2, len(texts)))
        return out / np.maximum(norm, 1e-9)[:, None] + self.bias

    def probabilities(self, texts: list[str], batch: int = 200) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(LANGUAGES)))
        z = np.concatenate([self.logits(texts[i : i + batch]) for i in range(0, len(texts), batch)]) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 7) -> None:
        """FTRL-proximal: per-coordinate steps, L1 for sparsity, L2 against large weights."""
        rows, buckets = grams(texts)
        order = np.argsort(rows, kind="stable")
        buckets = buckets[order]
        edges = np.searchsorted(rows[order], np.arange(len(texts) + 1))
        z, n = np.zeros((DIM + 1, len(LANGUAGES))), np.zeros((DIM + 1, len(LANGUAGES)))
        examples = []
        for i in range(len(texts)):
            at, count = np.unique(buckets[edges[i] : edges[i + 1]], return_counts=True)
            x = count * self.idf[at]
            norm = np.sqrt((count * self.idf[at] ** 2).sum())
            examples.append((np.append(at, DIM), np.append(x / max(norm, 1e-9), 1.0)))

        def weights(at: np.ndarray) -> np.ndarray:
            zi, ni = z[at], n[at]
            return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(texts)):
                at, x = examples[i]
                w = weights(at)
                score = x @ w
                p = np.exp(score - score.max())
                p /= p.sum()
                p[labels[i]] -= 1.0
                g = x[:, None] * p
                ni = n[at]
                z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[at] = ni + g * g
        every = weights(np.arange(DIM + 1))
        self.w, self.bias = every[:DIM].astype(np.float32), every[DIM]

    def calibrate(self, texts: list[str], labels: np.ndarray) -> None:
        """The temperature with the least negative log-likelihood on held-out sentences, whose labels count as ``TRUST`` right."""
        if not texts:
            return
        z = self.logits(texts)
        best = (np.inf, 1.0)
        for t in np.geomspace(0.05, 5.0, 60):
            s = z / t
            logp = s - s.max(1, keepdims=True)
            logp -= np.log(np.exp(logp).sum(1, keepdims=True))
            right = logp[np.arange(len(s)), labels]
            nll = -(TRUST * right + (1 - TRUST) / (len(LANGUAGES) - 1) * (logp.sum(1) - right)).mean()
            best = min(best, (nll, t))
        self.temperature = float(best[1])


def named_language(label: F.Column) -> F.Column:
    """The language that a label names, or null."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_ (].*)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(base.isin(*names), code).otherwise(out)
    return out


def train(records: DataFrame) -> Model:
    """A model from records (record_id, text, named): ``named`` is the language of the label or null."""
    model = Model(document_frequency(records))
    order = Window.partitionBy("named").orderBy(F.xxhash64("record_id"), "record_id")
    sample = (
        records.where("named is not null and text is not null")
        .select("record_id", "named", "text", F.row_number().over(order).alias("place"))
        .where(F.col("place") <= PER_LANGUAGE)
        .orderBy("named", "place")
        .toPandas()
    )
    texts, labels, held = [], [], []
    for place, named, text in zip(sample["place"], sample["named"], sample["text"]):
        for s in [s for s in sentences(text) if weight(s) >= LEAST][:PER_RECORD]:
            texts.append(s)
            labels.append(LANGUAGES.index(named))
            held.append(place % 5 == 0)
    labels, held = np.array(labels, np.int64), np.array(held, bool)
    if not len(texts):
        return model
    pick = lambda mask: [t for t, m in zip(texts, mask) if m]
    model.fit(pick(~held), labels[~held])
    p = model.probabilities(texts)
    agrees = p.argmax(1) == labels
    if agrees.any():
        model.fit(pick(~held & agrees), labels[~held & agrees])
        model.calibrate(pick(held & agrees), labels[held & agrees])
    return model


def segment(record_sentences: list[str], p: np.ndarray) -> list[tuple[str, float, int, str]]:
    """(language, confidence, number of sentences, text) of the stretches; the confidence is the calibrated probability of its language, averaged over its sure sentences by their letters."""
    out: list[list] = []
    for s, row in zip(record_sentences, p):
        k, letters = int(row.argmax()), weight(s)
        sure = row[k] >= SURE and letters >= LEAST
        if not out or (sure and out[-1][0] != LANGUAGES[k]):
            out.append([LANGUAGES[k], 0.0, 0.0, 0, []])
        if sure:
            out[-1][1] += letters * float(row[k])
            out[-1][2] += letters
        out[-1][3] += 1
        out[-1][4].append(s)
    if len(record_sentences) == 1 and not out[0][2]:
        out[0][1:3] = float(p[0].max()), 1.0
    return [(lang, mass / total if total else 0.0, n, " ".join(texts)) for lang, mass, total, n, texts in out]


def segments(records: DataFrame, model: Model) -> DataFrame:
    """Every stretch of every record: (record_kind, record_id, segment_no, lang, confidence, sentences, n_chars)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cut = [sentences(t) for t in frame["text"]]
            p = model.probabilities([s for c in cut for s in c])
            rows, at = [], 0
            for kind, record_id, c in zip(frame["record_kind"], frame["record_id"], cut):
                for no, (lang, confidence, n, text) in enumerate(segment(c, p[at : at + len(c)])):
                    rows.append((kind, record_id, no, lang, confidence, n, len(text)))
                at += len(c)
            yield pd.DataFrame(rows, columns=["record_kind", "record_id", "segment_no", "lang", "confidence", "sentences", "n_chars"])

    return records.where("text is not null").select("record_kind", "record_id", "text").mapInPandas(
        plain(run), "record_kind string, record_id string, segment_no int, lang string, confidence double, sentences int, n_chars int"
    )


def all_records(papers: DataFrame, messages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per record with a text: the text, the languages its labels name (null without a row in ``labels``), and one of them for training."""
    names = (
        labels.where("record_id is not null")
        .groupBy("record_kind", F.lower(F.trim("record_id")).alias("record_id"))
        .agg(F.collect_set(named_language(F.col("lang"))).alias("labelled"), F.max(named_language(F.col("lang"))).alias("named"))
    )
    texts = papers.select(F.lit("paper").alias("record_kind"), F.lower(F.trim("id")).alias("record_id"), F.col("abstract").alias("text")).unionByName(
        messages.select(F.lit("message").alias("record_kind"), F.lower(F.trim("id")).alias("record_id"), F.col("content").alias("text"))
    )
    return (
        texts.where("text is not null and record_id is not null")
        .join(names, ["record_kind", "record_id"], "left")
        .groupBy("record_kind", "record_id")
        .agg(F.max("text").alias("text"), F.first("labelled").alias("labelled"), F.first("named").alias("named"))
    )


def found(papers: DataFrame, messages: DataFrame, labels: DataFrame) -> DataFrame:
    """(record_kind, record_id, lang): for records in ``labels``, languages of the text that its label does not name."""
    from paperloom.session import cut_lineage

    records = cut_lineage(all_records(papers, messages, labels))
    model = train(records)
    known = records.where("labelled is not null")
    spoken = segments(known, model).where(F.col("confidence") >= SURE).select("record_kind", "record_id", "lang").distinct()
    named = known.select("record_kind", "record_id", F.explode("labelled").alias("lang"))
    return spoken.join(named, ["record_kind", "record_id", "lang"], "left_anti")


def languages(papers: DataFrame, messages: DataFrame, labels: DataFrame) -> DataFrame:
    """All segments of all records, labelled or not."""
    from paperloom.session import cut_lineage

    records = cut_lineage(all_records(papers, messages, labels))
    return segments(records, train(records))
