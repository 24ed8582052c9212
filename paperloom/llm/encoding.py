"""Text decoded with the wrong character encoding: detection and repair with a hidden Markov model.

States: one clean state, one state per (true encoding, wrong encoding) pair, and one state for characters that a decoder
put in place of bytes it could not read. A stretch of non-ASCII characters (joined over gaps of at most ``GAP`` ASCII
characters that are no letters) is labelled by the Viterbi path. The clean state emits a character by its class and the
class before it. A pair state emits what its true characters look like after the wrong reading: the emission of a group
of characters is the clean probability of the character that its bytes spell in the true encoding, so bytes that spell
nothing have probability zero. Where the wrong encoding reads two bytes at a time, the groups do not end together, and
the state carries the number of bytes still due. Every labelled span gets the inverse transform of its state; the result
is labelled again until nothing changes (text that was garbled twice), at most ``ROUNDS`` times.

Defined results: null and empty texts are clean; U+FFFD always counts as damage that cannot be repaired by itself;
rightly spelled foreign letters and symbols stay; a text is returned whole, whatever its length, and a stretch is labelled in
one go; ``complete`` says that every span could be decoded and that no other pair reads it nearly as well.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import spread

from .frames import plain

GAP = 8
ROUNDS = 4
_STRETCH = re.compile(r"[^\x00-\x7f]+(?:[\x00-\x40\x5b-\x60\x7b-\x7e]{1,%d}[^\x00-\x7f]+)*" % GAP)
LOST = "�"

#: Encodings that read UTF-8 byte by byte, and the log-probability of entering their state.
SINGLE = {"cp1252": -6.9, "latin-1": -6.9, "mac-roman": -7.5, "cp437": -7.5, "cp850": -8.5, "cp1251": -9.2, "cp1250": -9.2, "koi8-r": -9.2, "cp866": -9.2}
#: Encodings that read UTF-8 two bytes at a time.
DOUBLE = {"gbk": -16.0, "big5": -18.0, "shift_jis": -18.0, "euc_kr": -18.0}
#: By how much (log-probability) a restored text must beat every other reading to count as regained.
MARGIN = math.log(20)
STAY, LEAVE = math.log(0.98), math.log(0.3)
NEVER = -1e9


# Letter frequencies of Russian text, in per mille.
CYRILLIC = dict(
    zip(
        "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
        (109, 84, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1),
    )
)


@lru_cache(1 << 16)
def clean_class(ch: str) -> tuple[str, float]:
    """Class of a character and the log-probability that clean text shows it."""
    c = ord(ch)
    if c < 0x80:
        return "a", 0.0
    if ch == LOST or 0xE000 <= c <= 0xF8FF or c > 0x10000:
        return "x", math.log(1e-9)
    if c < 0xA0:
        return "c", math.log(1e-7)
    if ch in "“”‘’–—…„":
        return "t", math.log(0.2 / 8)
    if ch in "\xa0°±µ§":
        return "s", math.log(0.2 / 5)
    if ch in "«»¿¡·×€£©®™½²³÷":
        return "m", math.log(0.02 / 30)
    if 0xC0 <= c <= 0xDE:
        return "U", math.log(0.03 / 35)
    if 0xDF <= c <= 0xFF or ch == "œ":
        return "l", math.log(0.5 / 40)
    if 0xA0 <= c <= 0xBF:
        return "m", math.log(0.002 / 20)
    if 0x430 <= c <= 0x44F or c == 0x451:
        return "k", math.log(0.5 * CYRILLIC[ch] / 1000)
    if 0x410 <= c <= 0x42F or c == 0x401:
        return "K", math.log(0.05 * CYRILLIC[ch.lower()] / 1000)
    if 0x4E00 <= c <= 0x9FFF:
        try:
            row = ch.encode("gb2312")[0]
        except UnicodeEncodeError:
            return "h", math.log(1e-4 / 20000)
        return "h", math.log(0.8 / 3755 if row < 0xD8 else 0.01 / 3008)
    if ch in "，。、；：？！“”（）《》【】":
        return "p", math.log(0.1 / 10)
    if 0x100 <= c <= 0x17F:
        return "l" if ch.islower() else "U", math.log(0.01 / 100)
    if 0x370 <= c <= 0x3FF:
        return "g", math.log(1e-5)
    if 0x3040 <= c <= 0x312F:
        return "j", math.log(1e-6)
    return "o", math.log(1e-6)


#: Log factors for neighbouring classes in clean text; other neighbours are free.
NEXT = {("K", "K"): 2.0, ("k", "K"): -3.0, ("l", "l"): -3.0, ("U", "U"): -1.2, ("l", "U"): -3.5, ("U", "l"): -3.0} | {(a, b): -3.9 for a in "lU" for b in "msc"} | {("U", "t"): -3.9, ("l", "t"): -1.0}


def _bytes_of(codec: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)  # many decoders pass such bytes through
    return out


BYTES = {codec: _bytes_of(codec) for codec in SINGLE}
_NEED = [0] * 256
for _b in range(0xC2, 0xF5):
    _NEED[_b] = 1 if _b < 0xE0 else 2 if _b < 0xF0 else 3
#: Two-byte encodings read byte by byte, and the log-probability of entering their state.
PAIRED = {(true, wrong): -9.2 for true in ("gbk", "euc_kr", "shift_jis") for wrong in ("cp1252", "latin-1")}
#: Cyrillic encodings read as another single-byte encoding, letter by letter.
LETTERS = {
    ("cp1251", "cp1252"): -9.2, ("cp1251", "latin-1"): -9.2, ("koi8-r", "cp1252"): -9.2, ("koi8-r", "latin-1"): -9.2,
    ("koi8-r", "cp1251"): -6.0, ("cp1251", "koi8-r"): -8.0, ("cp866", "cp1251"): -9.2, ("cp1251", "cp866"): -9.2,
}
PAIRS = [("utf-8", w) for w in SINGLE] + [*PAIRED] + [*LETTERS] + [("utf-8", w) for w in DOUBLE]
ENTER = [*SINGLE.values(), *PAIRED.values(), *LETTERS.values(), *DOUBLE.values()]
FIRST_PAIRED, FIRST_LETTERS = len(SINGLE), len(SINGLE) + len(PAIRED)
FIRST_DOUBLE = FIRST_LETTERS + len(LETTERS)


@lru_cache(1 << 16)
def _two_bytes(ch: str, codec: str) -> bytes | None:
    try:
        raw = ch.encode(codec)
    except UnicodeEncodeError:
        return None
    return raw if len(raw) == 2 else None


def _lead(b: int) -> float:
    if 0xE4 <= b <= 0xE9:
        return math.log(0.8 / 6)
    if b in (0xE2, 0xE3, 0xEF):
        return math.log(0.05)
    if b in (0xC2, 0xC3, 0xD0, 0xD1):
        return math.log(0.02)
    return math.log(1e-4) if _NEED[b] else NEVER


@lru_cache(1 << 18)
def _double_step(ch: str, codec: str, due: int) -> tuple[float, int]:
    """Emission of one two-byte character with ``due`` bytes still owed, and the bytes owed after it."""
    raw = _two_bytes(ch, codec)
    if raw is None:
        return NEVER, 0
    score = 0.0
    for b in raw:
        if due:
            if not 0x80 <= b < 0xC0:
                return NEVER, 0
            due -= 1
            score -= math.log(64)
        elif b < 0x80:
            score += math.log(1e-3)  # an ASCII letter taken along as second byte
        else:
            score += _lead(b)
            due = _NEED[b]
    return score, due


@lru_cache(1 << 16)
def spoken(ch: str, true: str) -> float:
    """Log-probability that text in the language of a two-byte encoding shows ``ch``; NEVER for what it does not hold."""
    c = ord(ch)
    if true == "gbk":
        kind, score = clean_class(ch)
        return score if kind in "hp" else NEVER
    if 0x3001 <= c <= 0x3002 or 0xFF01 <= c <= 0xFF5E or ch in "「」『』（）":
        return math.log(0.1 / 20)
    if true == "euc_kr":
        return math.log(0.9 / 2350) if 0xAC00 <= c <= 0xD7A3 else math.log(1e-3 / 4888) if 0x4E00 <= c <= 0x9FFF else NEVER
    if 0x3041 <= c <= 0x30FC:
        return math.log(0.6 / 165)
    return math.log(0.3 / 2965 if ch.encode("shift_jis")[0] < 0x98 else 1e-3 / 3390) if 0x4E00 <= c <= 0x9FFF else NEVER


@lru_cache(1 << 17)
def _two_byte_group(lead: int, second: int, true: str) -> float:
    try:
        x = bytes([lead, second]).decode(true)
    except UnicodeDecodeError:
        return NEVER
    return spoken(x, true) - 6 * (second < 0x80) * (true != "shift_jis") if len(x) == 1 else NEVER


@lru_cache(1 << 16)
def _letter_group(ch: str, pair: int) -> float:
    true, wrong = PAIRS[pair]
    b = BYTES[wrong].get(ch)
    if b is None:
        return NEVER
    try:
        kind, score = clean_class(bytes([b]).decode(true))
    except UnicodeDecodeError:
        return NEVER
    return score if kind in "kK" or (kind in "stm" and wrong in ("cp1252", "latin-1")) else NEVER


_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_UTF8_TWICE = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){2}")
_CYRILLIC_OF = {at: frozenset(ch for ch in BYTES[PAIRS[at][1]] if _letter_group(ch, at) > NEVER and clean_class(bytes([BYTES[PAIRS[at][1]][ch]]).decode(PAIRS[at][0]))[0] in "kK") for at in range(FIRST_LETTERS, FIRST_DOUBLE)}
_LEADS = {codec: frozenset(ch for ch, b in table.items() if _NEED[b]) for codec, table in BYTES.items()}
_READ_AS = {codec: {ord(ch): b for ch, b in table.items()} for codec, table in BYTES.items()}


def _possible(stretch: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """The pairs of each kind whose state could emit any part of the stretch: readings of UTF-8, of two-byte encodings, of letters, and two bytes at a time."""
    present = set(stretch)
    singles = []
    for at, codec in enumerate(SINGLE):
        table = BYTES[codec]
        if not present.isdisjoint(_LEADS[codec]) and _UTF8.search("".join(c if c in table else " " for c in stretch).translate(_READ_AS[codec])):
            singles.append(at)
    paired = [at for at in range(FIRST_PAIRED, FIRST_LETTERS) if not present.isdisjoint(BYTES[PAIRS[at][1]])]
    letters = [at for at in range(FIRST_LETTERS, FIRST_DOUBLE) if not present.isdisjoint(_CYRILLIC_OF[at])]
    doubles = [at for at in range(FIRST_DOUBLE, len(PAIRS)) if LOST in present or _UTF8_TWICE.search(stretch.encode(PAIRS[at][1], "replace"))]
    return singles, paired, letters, doubles


def _groups(text: str, i: int, singles: list[int], paired: list[int], letters: list[int]) -> list[tuple[int, int, float]]:
    """(pair, length, log-probability) of every group that begins at ``i`` in a single-byte reading."""
    out = []
    ch = text[i]
    for at in singles:
        table = BYTES[PAIRS[at][1]]
        lead = table.get(ch)
        n = _NEED[lead] if lead is not None else 0
        if n and i + n < len(text):
            raw = [lead]
            for more in text[i + 1 : i + 1 + n]:
                b = table.get(more, 0)
                if not 0x80 <= b < 0xC0:
                    break
                raw.append(b)
            else:
                try:
                    x = bytes(raw).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out.append((at, n + 1, clean_class(x)[1]))
    if i + 1 < len(text):
        for at in paired:
            true, wrong = PAIRS[at]
            table = BYTES[wrong]
            if ch in table:
                b = table.get(text[i + 1], ord(text[i + 1]) if text[i + 1] < "\x80" else 0)
                score = _two_byte_group(table[ch], b, true) if b >= 0x40 else NEVER
                if score > NEVER / 2:
                    out.append((at, 2, score))
    for at in letters:
        score = _letter_group(ch, at)
        if score > NEVER / 2:
            out.append((at, 1, score))
    return out


def _viterbi(stretch: str) -> tuple[tuple[int, int, int], ...]:
    """(begin, end, pair) of the spans that are not clean; pair -1 stands for lost characters.

    A path is held as the chain of its spans (begin, pair, chain before), so a stretch of any length is labelled in one
    go: only the states of the next few characters and the spans of the paths still alive are in memory.
    """
    singles, paired, letters, doubles = _possible(stretch)
    if not (singles or paired or letters or doubles or LOST in stretch) and not any(0x80 <= ord(c) < 0xA0 for c in stretch):
        return ()
    n = len(stretch)
    first = (0, -2, None)
    ahead: list[dict] = [{(-2, 0): (0.0, first)}, {}, {}, {}, {}]

    def offer(by: int, state: tuple[int, int], score: float, chain: tuple, i: int) -> None:
        here = ahead[by]
        if score > NEVER / 2 and (state not in here or here[state][0] < score):
            here[state] = (score, chain if chain[1] == state[0] else (i, state[0], chain))

    previous = "a"
    for i in range(n):
        ch = stretch[i]
        kind, emit = clean_class(ch)
        emit += NEXT.get((previous, kind), 0.0)
        groups = _groups(stretch, i, singles, paired, letters) if kind != "a" else []
        for state, (score, chain) in ahead[0].items():
            pair, due = state
            out = score if pair == -2 else score + (LEAVE if due == 0 else -12.0)
            if kind == "a":
                offer(1, state, score, chain, i) if due == 0 else offer(1, (-2, 0), out, chain, i)
                continue
            offer(1, (-2, 0), out + emit, chain, i)
            if ch == LOST:
                offer(1, (-1, 0), (score if pair == -1 else out - 2.0) - 1.0, chain, i)
                if pair >= FIRST_DOUBLE:
                    for owed in (0, 1, 2):
                        offer(1, (pair, owed), score - 5.0, chain, i)
            if due == 0:
                for k, length, probability in groups:
                    offer(length, (k, 0), (score + STAY if k == pair else out + ENTER[k]) + probability, chain, i)
            for k in doubles:
                if k == pair or due == 0:
                    step, owed = _double_step(ch, PAIRS[k][1], due if k == pair else 0)
                    if step > NEVER / 2:
                        offer(1, (k, owed), (score if k == pair else out + ENTER[k]) + step, chain, i)
        previous = kind
        ahead = [*ahead[1:], {}]
    _, chain = max(ahead[0].items(), key=lambda x: x[1][0] - (8.0 if x[0][1] and x[0][0] >= FIRST_DOUBLE else 0.0))[1]
    end, spans = n, []
    while chain is not None:
        begin, pair, before = chain
        if pair != -2 and begin < end:
            spans.append((begin, end, pair))
        end, chain = begin, before
    # a few capitals alone are no evidence of another alphabet
    return tuple(x for x in reversed(spans) if not (FIRST_LETTERS <= x[2] < FIRST_DOUBLE and PAIRS[x[2]][1] in ("cp1252", "latin-1") and x[1] - x[0] < 4 and stretch[x[0] : x[1]].isupper()))


_remembered = lru_cache(1 << 15)(_viterbi)


def label(stretch: str) -> tuple[tuple[int, int, int], ...]:
    return _remembered(stretch) if len(stretch) <= 200 else _viterbi(stretch)


def _whole_words(stretch: str, spans: tuple[tuple[int, int, int], ...]) -> list[tuple[int, int, int]]:
    """Spans of Cyrillic letters grow over at most two clean letters left at either end of a word."""
    out = []
    for at, (begin, end, pair) in enumerate(spans):
        if FIRST_LETTERS <= pair < FIRST_DOUBLE:
            table = BYTES[PAIRS[pair][1]]
            low = out[-1][1] if out else 0
            high = spans[at + 1][0] if at + 1 < len(spans) else len(stretch)
            left, right = begin, end
            while left > low and stretch[left - 1].isalpha() and stretch[left - 1] in table:
                left -= 1
            while right < high and stretch[right].isalpha() and stretch[right] in table:
                right += 1
            begin, end = left if begin - left <= 2 else begin, right if right - end <= 2 else end
        out.append((begin, end, pair))
    return out


def undo(span: str, pair: int) -> tuple[str, bool]:
    """The text a span stands for, and whether every character of it could be regained."""
    if pair < 0:
        return span, False
    true, wrong = PAIRS[pair]
    if wrong in SINGLE:
        table = BYTES[wrong]
        raw = b"".join(bytes([table[ch]]) if ch in table else ch.encode("utf-8") for ch in span)
    else:
        raw = b"".join((ch.encode(wrong, "ignore") or b"?") if ch != LOST else b"?" for ch in span)
    try:
        return raw.decode(true), LOST not in span
    except UnicodeDecodeError:
        return raw.decode(true, "replace"), False


@lru_cache(1 << 12)
def _text_score(text: str, true: str) -> float:
    """Log-probability of a restored text, by the language its encoding stands for."""
    if true in ("euc_kr", "shift_jis"):
        return sum(max(spoken(ch, true), clean_class(ch)[1] if ch < "\x80" else -20.0) for ch in text)
    return sum(max(clean_class(ch)[1], -20.0) for ch in text)


def certain(span: str, pair: int, fixed: str) -> bool:
    """Whether no other pair turns the span into another text nearly as probable."""
    own = _text_score(fixed, PAIRS[pair][0])
    for other in range(len(PAIRS)):
        if other != pair and all(ch < "\x80" or ch in BYTES[PAIRS[other][1]] for ch in span) if PAIRS[other][1] in SINGLE else False:
            text, decoded = undo(span, other)
            if decoded and text != fixed and _text_score(text, PAIRS[other][0]) > own - MARGIN:
                return False
    return True


def repair(text: str | None) -> tuple[str | None, int, str, bool]:
    """(text after repair, number of spans, their pairs, whether everything could be regained)."""
    if not text or text.isascii():
        return text, 0, "", True
    spans, names, whole, current = 0, [], True, text
    for turn in range(ROUNDS):
        pieces, at, changed = [], 0, False
        for match in _STRETCH.finditer(current):
            stretch = match.group()
            for begin, end, pair in _whole_words(stretch, label(stretch)):
                begin, end = begin + match.start(), end + match.start()
                fixed, complete = undo(current[begin:end], pair)
                complete = complete and certain(current[begin:end], pair, fixed)
                if turn == 0 or pair >= 0:
                    spans += 1
                    names.append("lost" if pair < 0 else "/".join(PAIRS[pair]))
                whole &= complete
                changed |= fixed != current[begin:end]
                pieces += [current[at:begin], fixed]
                at = end
        current = "".join(pieces) + current[at:]
        if not changed:
            break
    return current, spans, ",".join(sorted(set(names))), whole


def repaired(documents: DataFrame) -> DataFrame:
    """One row per affected document: restored text, number of damaged spans, encoding pairs, and whether all of it was regained."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(doc_id, *found) for doc_id, text in zip(frame["doc_id"], frame["text"]) if (found := repair(text))[1]]
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "spans", "pairs", "complete"])

    texts = documents.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return spread(texts).mapInPandas(plain(run), "doc_id long, restored string, spans int, pairs string, complete boolean")


def found(documents: DataFrame) -> DataFrame:
    return repaired(documents).select("doc_id").distinct()
