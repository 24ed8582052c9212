"""Question and answer pairs with their defects, from noisy labelling functions and an EM label model.

A pair is a user message and the assistant message directly after it in the same conversation. For each of the defects
``DEFECTS`` several labelling functions vote on every pair; one label model per defect is fitted on the counts of the
vote patterns of all pairs, and a label is kept where its posterior exceeds ``CUTOFFS`` (held against answers with
injected defects in the tests). A pair may keep several labels; ``defect`` is the first of them in the order of
``DEFECTS``, which runs from what leaves nothing to judge to what needs a whole text.

Two functions learn from the data: how refusals are worded (``Wording``, from a bounded sample and the other functions'
votes, so it also finds refusals in words that no phrase lists), and how short an unended list item is when it was broken
off (``item_lengths``, over all answers).

Defined results: null or blank answers are ``empty``; a blank question has no language and cannot be copied; repeated
message ids count once; very long texts are read whole; with too few refusals to learn from the wording has no vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut_lineage

from .conversations import blank, clean_id, normalised, once, placed, speaker
from .frames import plain
from .labelmodel import Declared, LabelModel

DEFECTS = ("empty", "copy", "refusal", "truncated", "wrong_language")
CUTOFFS = {"empty": 0.5, "copy": 0.5, "refusal": 0.5, "truncated": 0.5, "wrong_language": 0.5}
LEAD_IN = 14
#: Answers from which the wording of refusals is learned, hash buckets of its features, and how often one must be seen.
SAMPLE, BUCKETS, LEAST_SEEN = 6_000, 1 << 15, 3
#: Where the answers hold too few lists to measure, and the share of the measured length (``item_lengths``).
ITEM_LENGTHS, SHORT = {False: 30.0, True: 10.0}, 0.6

_CONTENT = re.compile(r"[^\W_]")
_NOISE = re.compile(r"[\W_]+")
_TOKEN = re.compile(r"[一-鿿]|[^\W_]+")
_FENCE = re.compile(r"```.*?```", re.S)
_MATH = re.compile(r"\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$|\$[^$\n]+\$", re.S)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’)]*\s+|(?<=[。！？])[”’]*|\n+")
#: What names something: a number, a word with a capital inside, a capitalised word after a Chinese character or within a sentence.
_SUBSTANCE = re.compile(r"\d|\b[A-Z][a-z]+[A-Z][a-z]+\b|[一-鿿][A-Z][a-z]{3,}|[a-z,] [A-Z][a-z]{4,}")
_HAN = re.compile(r"[一-鿿]")
_CYRILLIC = re.compile(r"[а-яё]", re.I)
_LATIN = re.compile(r"[a-zà-ÿ]", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
_END = re.compile(r"[.!?…。！？][\"”’»」』)\]*_`]*$")

# Phrases by which a reading assistant declines, in the languages of the data.
DECLINE = re.compile(
    r"\b(?:i|we)(?:'m| am| are)? (?:not able|unable|not allowed|not permitted|obliged to decline)\b"
    r"|\b(?:i|we) (?:can ?not|can['’]t|won['’]t|will not|would rather not|don['’]t feel|do not feel|am not|prefer not|shall not|may not)\b.*\b(?:help|assist|answer|provide|decline|pass on|discuss|comment|go into|comfortable|able|share|respond|comply|do that|do this)"
    r"|\b(?:i|we|must|have to|has to|will|would|shall|respectfully)\b.{0,25}\b(?:decline|refuse)\b|\bnot able to answer\b|\b(?:would |['’]d )?(?:rather|prefer) not\b|\b(?:leave|leaving|left|remains?|stays?|go|goes)\b.{0,80}\bunanswered\b"
    r"|\b(?:i|we) (?:must|have to) (?:pass on|turn down|withhold)\b"
    r"|\bno (?:answer|reply|response|comment)\b.{0,60}\b(?:given|possible|available|provided|offered|made|from me)\b|\b(?:keeps?|prevents?|stops?|bars?|forbids?|prohibits?)\b (?:me|us|this assistant) (?:from|to)\b|\b(?:guidelines?|rules?|instructions?|policy|policies)\b.{0,30}\b(?:forbid|prohibit|do not allow|don['’]t allow|do not permit|don['’]t permit|rule out)\w*"
    r"|\b(?:i|we) (?:am|are|['’]m|['’]re) (?:barred|forbidden|prohibited|prevented|unwilling|in no position|not in a position)\b|\b(?:off limits|out of bounds)\b|\b(?:outside|beyond) (?:my|our|the) (?:scope|remit|role|task|domain)\b|\boutside what i\b|\bwon['’]t be able\b|\bgo into that\b|\bbeyond what i\b"
    r"|\bje (?:ne|n['’])\s*\w+ (?:pas|plus)\b|\bje (?:dois|préfère|suis dans l['’]impossibilité)\b.*(?:refus|décliner|pas|répondre|aider)|\bil m['’]est impossible\b|\bm['’]est interdit|\bm['’](?:interdi|empêch)\w+|\b(?:reste|restera|laisse\w*|rester)\b.*\bsans réponse\b|\baucune réponse\b.*\b(?:donnée|fournie|possible)\b|\bje (?:refuse|décline|m['’]abstiens)\b|\bpréfère ne pas\b"
    r"|\b(?:kann|darf|möchte|werde) ich\b.*\bnicht\b|\bich (?:kann|darf|möchte|werde)\b.*\bnicht\b|\bmuss ich\b.*\bablehnen\b|\bich muss\b.*\bablehnen\b|\bist mir nicht (?:möglich|erlaubt|gestattet)\b|\b(?:bleibt|bleiben|lasse ich|muss ich)\b.*\bunbeantwortet\b|\bkeine (?:antwort|auskunft)\b.*\b(?:geben|gegeben|erteilt|erteilen|möglich)\b|\b(?:untersag|verbiet|verwehr)\w+\b.*\bmir\b|\bich (?:verweigere|lehne)\b"
    r"|\bno (?:puedo|debo|me es posible|me está permitido|estoy autorizad)|\bdebo rechazar\b|\bme es imposible\b|\btengo que rechazar\b|\bprefiero no\b|\bme (?:impiden?|prohíben?)\b|\b(?:queda|dejo|dejar)\b.*\bsin respuesta\b|\bno (?:se dará|daré|habrá) (?:ninguna )?respuesta\b|\b(?:rechazo|declino)\b.*\b(?:responder|consulta|petición|solicitud)\b"
    r"|\bя не (?:могу|буду|вправе|имею права)|\bмне (?:нельзя|не разрешено|не позволено)|\bвынужден\w* (?:отказать|отклонить)|\bотклон(?:ить|яю)\b.*\b(?:запрос|вопрос)|\bвыходит за рамки\b|\bостав\w+\b.*\bбез ответа\b|\bответа? (?:не будет|не дам)\b|\bпредпоч\w+ не\b|\bне (?:разрешают|позволяют) мне\b|\bмне запре\w+|\bзапрещают мне\b|\bвоздерж\w+|\bне уполномочен|\bне могу\b.*\b(?:ответить|помочь|обсуждать|предоставить)"
    r"|我(?:无法|不能|不便|只能拒绝|没办法)|(?:无法|不能|不便)(?:回答|提供|讨论|帮助|协助)|只能拒绝|超出了?我的|恕(?:我)?(?:无法|不能|难|不)|不予(?:回答|置评|回应|作答)|拒绝(?:回答|回应|评论)|不作(?:答|评论)|(?:规定|准则|政策).{0,12}(?:不允许|禁止|不得)|宁可不|暂不回答",
    re.I | re.S,
)
APOLOGY = re.compile(
    r"^\W*(?:i['’]?m (?:really |very |so )?sorry|i am sorry|sorry|apologies|i apologi[sz]e|unfortunately|thanks? for asking|thank you for|désolée?|je suis désolée?|malheureusement|pardon|je regrette|es tut mir leid|tut mir leid|leider|entschuldigung|verzeihung|lo siento|lamentablemente|disculp\w+|perdón|desafortunadamente|lamento|извините|простите|к сожалению|прошу прощения|сожалею|抱歉|很抱歉|对不起|不好意思|非常抱歉|遗憾)",
    re.I,
)
REDIRECT = re.compile(
    r"\bplease (?:ask|try|contact|rephrase|choose|consult)\b|\bask (?:something|another|me something)\b|\bpolicy\b|\bbitte (?:stelle|stellen|frag|wende)\w*|\bpor favor\b|\bhaga? otra\b|\bhaz otra\b|\bposez\b|\bveuillez\b|\bautre question\b|\bзадайте\b|\bдругой вопрос\b|\bобратитесь\b|请您?换|建议(?:直接)?联系|请换|请咨询",
    re.I,
)
STOPWORDS = {
    "en": (
        "the of and is are was were that for with to by on not this in we it an at from be a which should only no yes across when does what how would them each more better between about "
        "against after before during near under over without within behind but than its their our your you they has have had been being may might will can could must do did if so or as all both through into while because since until per using used every there these those also where who why i my he she his her us"
    ).split(),
    "de": (
        "der die das den dem des und nicht wird wurde wie ist sind dass werden haben hat für bei von zu auf ein eine einen warum ob nur sich kaum über es ich diese in mit auf was welche im "
        "einer eines einem als auch aber aus nach vor unter zwischen durch gegen ohne um war waren wir sie er kann können soll sollte könnten bislang noch schon mehr sehr zum zur vom am beim wenn weil damit oder jedoch diesem dieser dieses kein keine ja nein"
    ).split(),
    "fr": (
        "le la les des du une un est et que qui dans pour été sur plus avec sont ont comment pourquoi si n'a au aux ce cette en de ne pas je vous nous par reste l'on "
        "il elle ils elles son sa ses leur leurs mais ou où donc car comme sans sous entre vers chez peut peuvent être avoir fait très aussi même quand cet ces notre votre était étaient oui non afin mieux selon"
    ).split(),
    "es": (
        "el los las una un es que por del se en fue sobre para con más y la de cómo no como sin lo al su puede son está resultó qué dos "
        "pero o u ni si sus este esta estos estas ese esa muy también entre desde hasta cuando donde porque ser era eran ha han fueron nos nosotros sí solo según durante bajo cada otro otra todos mejor"
    ).split(),
}
MARKS = {"de": "äöüß", "fr": "àâçèêëîïôûùœ", "es": "áíóúñ¿¡"}
#: Language names that a question may ask for.
ASKED = {
    "en": r"\benglish\b|\benglisch\w*|\banglais\w*|\bingl[ée]s\w*|английск|英[文语]",
    "zh": r"\bchinese\b|\bchinesisch\w*|\bchinois\w*|\bchino\b|китайск|中文|汉语|汉文|漢語",
    "de": r"\bgerman\b|\bdeutsch\w*|\ballemand\w*|\balemán\w*|немецк|德[文语]",
    "fr": r"\bfrench\b|\bfranzösisch\w*|\bfrançais\w*|\bfrancés\w*|французск|法[文语]",
    "es": r"\bspanish\b|\bspanisch\w*|\bespagnol\w*|\bespañol\w*|\bcastellano\b|испанск|西班牙[文语]",
    "ru": r"\brussian\b|\brussisch\w*|\brusse\b|\bruso\b|русск|俄[文语]",
}
ASKED = {k: re.compile(v, re.I) for k, v in ASKED.items()}


def squeezed(text: str) -> str:
    return _NOISE.sub("", text.lower())


def plain_sentences(text: str) -> list[str]:
    """Sentences without code, formulas and list marks."""
    rest = _MATH.sub(" ", _FENCE.sub("\n", text))
    return [s for s in (_ITEM.sub("", p).strip() for p in _SENTENCE.split(rest)) if _CONTENT.search(s)]


def by_script(sentence: str) -> str:
    """zh, ru, latin or '' by the letters of a sentence; names in Latin letters count less."""
    if len(_HAN.findall(sentence)) >= 2:
        return "zh"
    if len(_CYRILLIC.findall(sentence)) >= 3:
        return "ru"
    return "latin" if len(_LATIN.findall(sentence)) >= 3 else ""


def _best(scores: dict[str, int]) -> str:
    ranked = sorted(scores.values())
    return max(scores, key=lambda k: scores[k]) if ranked[-1] > ranked[-2] else ""


_FUNCTION_WORD = re.compile(r"[a-zà-ÿœ'’]+")
_LETTERS = re.compile(r"[^\W\d_]{4,}")
_ENDINGS = {"en": ("ing", "ed", "ly", "ght", "th"), "de": ("ung", "en", "lich", "cht"), "fr": ("ée", "ent", "eux", "que"), "es": ("ción", "ado", "ada", "os", "as")}


def spoken_as(sentence: str) -> tuple[str, str, str]:
    """The language of a sentence by its script, by its function words, and by its endings and accented letters alone."""
    script = by_script(sentence)
    if script != "latin":
        return script, script, script
    low = sentence.lower()
    words = _FUNCTION_WORD.findall(low)
    longer = _LETTERS.findall(low)
    marks = {k: sum(low.count(c) for c in MARKS.get(k, "")) * 2 + sum(w.endswith(v) for w in longer) for k, v in _ENDINGS.items()}
    return script, _best({k: sum(w in v for w in words) for k, v in _STOP.items()}), _best(marks)


_STOP = {k: frozenset(v) for k, v in STOPWORDS.items()}


def copy_votes(question: str, answer: str) -> list[int]:
    parts = [question] + [p for p in re.split(r"\n\s*-{3,}\s*\n", question) if p.strip() and p != question]
    answer_flat = squeezed(answer)
    rest, share = None, 0.0
    answer_words = Counter(_TOKEN.findall(answer.lower()))
    for part in parts:
        flat = squeezed(part)
        if len(flat) >= 4 and flat in answer_flat:
            left = len(answer_flat.replace(flat, ""))
            rest = left if rest is None else min(rest, left)
        words = set(_TOKEN.findall(part.lower()))
        if len(words) > 2 and answer_words:
            share = max(share, min(len(words & set(answer_words)) / len(words), len(words & set(answer_words)) / len(answer_words)))
    if not answer_flat:
        return [-1, -1, -1]
    exact = 1 if rest is not None and rest <= LEAD_IN else -1
    same = -1 if share < 0.7 or (rest or 0) > 25 else 1 if share >= 0.8 else 0
    return [exact, same, 1 if rest is not None and rest == 0 else -1 if rest is None or rest > 25 else 0]


def refusal_votes(answer: str, wording: Wording | None = None) -> list[int]:
    found = plain_sentences(answer)
    if not found:
        return [-1, -1, -1, 0, 0]
    opens = APOLOGY.match(found[0]) is not None
    redirects = [REDIRECT.search(s) is not None for s in found]
    known: dict[int, bool] = {}

    def declines(i: int) -> bool:
        if i not in known:
            known[i] = DECLINE.search(found[i]) is not None
        return known[i]

    def kind(i: int) -> bool:
        return redirects[i] or APOLOGY.match(found[i]) is not None or declines(i)

    every, any_decline = -1, 0
    # a sentence that names something and declines nothing settles the matter, so it is looked for first
    substance = any(_SUBSTANCE.search(s) is not None and not kind(i) for i, s in enumerate(found))
    if not substance:
        any_decline = int(any(declines(i) for i in range(len(found))))
        if any_decline:
            every = 1 if all(kind(i) for i in range(len(found))) else -1
        else:
            every = -1 if wording is None else 0
    return [
        every,
        1 if opens and len(found) <= 3 else 0,
        -1 if substance else any_decline,
        1 if any(redirects[1:]) else 0 if len(found) <= 2 else -1,
        wording.vote(answer) if wording is not None else 0,
    ]


def truncated_votes(answer: str, items: dict[bool, float] = ITEM_LENGTHS) -> list[int]:
    text = answer.strip()
    if not _CONTENT.search(text):
        return [-1, -1, -1, -1]
    fence = text.count("```") % 2 == 1
    rest = _FENCE.sub("", text)
    bare = _MATH.sub("", rest)
    opened = fence or "\\[" in bare or "\\(" in bare or bare.count("$$") % 2 == 1 or bare.count("$") % 2 == 1 or re.search(r"\\begin\{(\w+)\}(?!.*\\end\{\1\})", rest, re.S)
    dangling = re.search(r"[,，、;；:：(（\[{=+\-–—/&]$", text) is not None
    closed = text.endswith("```") or re.search(r"(?:\\\]|\\\)|\$)$", text) is not None and any(m.end() == len(rest) for m in _MATH.finditer(rest))
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1]
    listed = _ITEM.match(last) is not None
    bulleted = sum(_ITEM.match(x) is not None for x in lines)
    ended = _END.search(text) is not None
    quoted = last.lstrip().startswith(">") and ended
    found = plain_sentences(text)
    words = len(_TOKEN.findall(last))
    if opened or (dangling and not closed and not re.fullmatch(r"[-*_=]{2,}", last.strip())):
        structure = 1
    else:
        structure = -1 if ended or closed or quoted else 0
    if ended or closed:
        prose = -1
    elif listed:
        prose = 0
    else:
        prose = 1 if len(found) > 1 or words > 7 else -1 if words <= 6 else 0
    fragment = 0
    if listed and not ended and not closed:
        fragment = 1 if len(_ITEM.sub("", last)) < items[_HAN.search(text) is not None] else -1
    return [structure, prose, fragment, -1 if ended else 1 if (listed and fragment == 1) or (not listed and prose == 1) or opened else -1 if listed or closed or bulleted else 0]


_RULE = re.compile(r"\n\s*-{3,}\s*\n")


def language_votes(question: str, answer: str) -> list[int]:
    asked = {k for k, v in ASKED.items() if v.search(question)}
    last = [spoken_as(t) for t in (_RULE.split(question)[-1], question)]
    said = [spoken_as(s) for s in plain_sentences(answer) if len(_TOKEN.findall(s)) >= 3]
    out = []
    for way in range(3):
        spoken = last[0][way] or last[1][way]
        heard = [s[way] for s in said if s[way]]
        wanted = {spoken} | (asked if way else {a if a in ("zh", "ru") else "latin" for a in asked})
        if not spoken or not heard:
            out.append(0)
        elif any(h in wanted for h in heard):
            out.append(-1 if way or spoken != "latin" else 0)
        else:
            out.append(1)
    return out


class Wording:
    """How answers that decline are worded, learned from the answers themselves: naive Bayes over hashed words and neighbouring words.

    The labels are those of the other labelling functions on a bounded sample; features seen fewer than ``LEAST_SEEN``
    times say nothing. The votes' limits are set on the part of the sample that was not learned from: for a refusal
    where at most one answer in a hundred is none by the other functions, against it where nearly every refusal lies above.
    """

    def __init__(self, answers: list[str]) -> None:
        votes = [refusal_votes(a) for a in answers]
        label = np.array([v[0] == 1 and v[2] == 1 for v in votes], bool)
        self.weights, self.high, self.low = np.zeros(BUCKETS), np.inf, -np.inf
        learned = np.arange(len(answers)) % 3 > 0
        if min(label[learned].sum(), (~label[learned]).sum(), label[~learned].sum()) < LEAST_SEEN:
            return
        counts = np.zeros((2, BUCKETS))
        for a, y in zip((answers[i] for i in np.flatnonzero(learned)), label[learned]):
            counts[int(y), self.features(a)] += 1
        n0, n1 = (~label[learned]).sum(), label[learned].sum()
        self.weights = np.where(counts.sum(0) >= LEAST_SEEN, np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1)), 0.0)
        scores = np.array([self.score(answers[i]) for i in np.flatnonzero(~learned)])
        held = label[~learned]
        self.high = max(0.0, float(np.quantile(scores[~held], 0.99)))
        self.low = min(self.high, float(np.quantile(scores[held], 0.02)))

    @staticmethod
    def features(answer: str) -> np.ndarray:
        from xxhash import xxh32_intdigest

        words = [w.lower() for w in _TOKEN.findall(answer)]
        return np.unique([xxh32_intdigest(w) % BUCKETS for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]).astype(np.int64)

    def score(self, answer: str) -> float:
        return float(self.weights[self.features(answer)].sum())

    def vote(self, answer: str) -> int:
        score = self.score(answer)
        return 1 if score > self.high else -1 if score < self.low else 0


def wording_of(messages: DataFrame, sample: int | None = None) -> Wording:
    """Learned from the ``SAMPLE`` assistant messages with the smallest hashes of their ids, the only bounded sample here."""
    said = messages.where((speaker("role") == "assistant") & F.col("id").isNotNull() & ~blank("content")).select(F.xxhash64(clean_id("id")).alias("h"), "content")
    return Wording([r.content for r in said.orderBy("h", "content").limit(SAMPLE if sample is None else sample).collect()])


def item_lengths(messages: DataFrame) -> dict[bool, float]:
    """By whether a text is Chinese: the length under which an unended last list item counts as broken off, ``SHORT`` of the length that nearly all (99 of 100) other unended items of all answers reach."""
    lines = messages.where(speaker("role") == "assistant").select(F.col("content").rlike("[一-鿿]").alias("han"), F.split(F.regexp_replace("content", r"\s+$", ""), "\n").alias("lines"))
    items = lines.select("han", F.explode(F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line")).where(F.col("line").rlike(r"^\s*(?:[-*•]|\d+[.)])\s+") & ~F.col("line").rlike(r"[.!?…。！？][\"”’»」』)\]*_`]*\s*$"))
    rows = items.select("han", F.length(F.regexp_replace("line", r"^\s*(?:[-*•]|\d+[.)])\s+", "")).alias("n")).groupBy("han").agg(F.percentile_approx("n", 0.01, 1000).alias("n"), F.count("*").alias("seen")).where(F.col("seen") >= 100).collect()
    return ITEM_LENGTHS | {bool(r.han): SHORT * r.n for r in rows}


FUNCTIONS = {
    "empty": [Declared("no letter or digit", 0.999, 0.999), Declared("hardly a character", 0.6, 0.99)],
    "copy": [Declared("question and a short lead-in", 0.98, 0.995), Declared("same words", 0.9, 0.95), Declared("nothing but the question", 0.99, 0.9)],
    "refusal": [Declared("every sentence declines or apologises", 0.97, 0.99), Declared("opens with an apology", 0.6, 0.6), Declared("declines and names nothing", 0.9, 0.95), Declared("points elsewhere", 0.6, 0.7), Declared("wording", 0.9, 0.95)],
    "truncated": [Declared("open fence, formula or clause", 0.97, 0.9), Declared("prose without an end", 0.9, 0.97), Declared("fragment of a list item", 0.95, 0.9), Declared("form of the ending", 0.85, 0.97)],
    "wrong_language": [Declared("script", 0.97, 0.8), Declared("function words", 0.95, 0.97), Declared("letters and endings", 0.7, 0.8)],
}


def votes(question: str | None, answer: str | None, wording: Wording | None = None, items: dict[bool, float] = ITEM_LENGTHS) -> dict[str, list[int]]:
    q, a = question or "", answer or ""
    if not _CONTENT.search(a):
        return {"empty": [1, 1 if len(a.strip()) < 8 else 0], "copy": [-1] * 3, "refusal": [-1, 0, 0, 0, 0], "truncated": [-1] * 4, "wrong_language": [0] * 3}
    return {
        "empty": [-1, -1 if len(a) > 8 else 0],
        "copy": copy_votes(q, a) if _CONTENT.search(q) else [-1] * 3,
        "refusal": refusal_votes(a, wording),
        "truncated": truncated_votes(a, items),
        "wrong_language": language_votes(q, a) if _CONTENT.search(q) else [0] * 3,
    }


def pairs(messages: DataFrame) -> DataFrame:
    """(conversation_id, message_id, question, answer) of every user message with the assistant message directly after it."""
    rows = once(placed(normalised(messages, content=True)))
    order = Window.partitionBy("conv", "fragment").orderBy("second", "turn", "mid")
    inside = rows.select("conv", "fragment", "speaker", "mid", "content", "second", "turn", F.lag(F.struct("speaker", "content")).over(order).alias("before"))
    direct = inside.where("before is not null and speaker = 'assistant' and before.speaker = 'user'").select("conv", "mid", F.col("before.content").alias("question"), F.col("content").alias("answer"))
    # a question at the end of one fragment and its answer at the beginning of the next
    key = F.struct("second", "turn", "mid")
    edges = rows.groupBy("conv", "fragment").agg(F.min(F.struct(key.alias("k"), "speaker", "mid", "content")).alias("first"), F.max(F.struct(key.alias("k"), "speaker", "mid", "content")).alias("last"))
    several = edges.where("first.k.second is not null").groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    across = edges.join(several, "conv", "left_semi").withColumn("before", F.lag("last").over(Window.partitionBy("conv").orderBy("fragment")))
    bridged = across.where("before.speaker = 'user' and first.speaker = 'assistant'").select("conv", F.col("first.mid").alias("mid"), F.col("before.content").alias("question"), F.col("first.content").alias("answer"))
    return direct.unionByName(bridged).select(F.col("conv").alias("conversation_id"), F.col("mid").alias("message_id"), "question", "answer")


def voted(found_pairs: DataFrame, wording: Wording | None = None, items: dict[bool, float] = ITEM_LENGTHS) -> DataFrame:
    """(message_id, <defect> string of votes) for every pair; the texts stay behind."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [votes(q, a, wording, items) for q, a in zip(frame["question"], frame["answer"])]
            yield pd.DataFrame({"message_id": frame["message_id"], **{d: ["".join("-0+"[v + 1] for v in r[d]) for r in rows] for d in DEFECTS}})

    return found_pairs.select("message_id", "question", "answer").mapInPandas(plain(run), "message_id string, " + ", ".join(f"{d} string" for d in DEFECTS))


def fit_models(ballots: DataFrame) -> dict[str, dict[str, float]]:
    """Per defect the posterior of every vote pattern that occurs (at most 3^5 of them)."""
    out = {}
    sets = ballots.groupingSets([[d] for d in DEFECTS], *DEFECTS).agg(F.count("*").alias("count"), F.grouping_id().alias("set")).toPandas()
    for at, d in enumerate(DEFECTS):
        counted = sets[sets["set"] == (1 << len(DEFECTS)) - 1 - (1 << (len(DEFECTS) - 1 - at))]
        if not len(counted):
            out[d] = {}
            continue
        patterns = np.array([["-0+".index(c) - 1 for c in p] for p in counted[d]])
        model = LabelModel(FUNCTIONS[d]).fit(patterns, counted["count"].to_numpy())
        out[d] = dict(zip(counted[d], (float(x) for x in model.posterior(patterns))))
    return out


def judged(messages: DataFrame) -> DataFrame:
    """(message_id, posteriors map, labels array, defect) of every pair."""
    ballots = cut_lineage(voted(pairs(messages), wording_of(messages), item_lengths(messages)))
    posterior = fit_models(ballots)
    columns = {}
    for d in DEFECTS:
        table = posterior[d]
        value = F.create_map(*(F.lit(x) for item in table.items() for x in item))[F.col(d)] if table else F.lit(0.0)
        columns[d] = F.coalesce(value, F.lit(0.0))
    kept = F.filter(F.array(*(F.when(columns[d] >= CUTOFFS[d], d) for d in DEFECTS)), lambda x: x.isNotNull())
    scores = F.create_map(*(x for d in DEFECTS for x in (F.lit(d), columns[d])))
    return ballots.select("message_id", scores.alias("posteriors"), kept.alias("labels")).withColumn("defect", F.try_element_at("labels", F.lit(1)))


def found(messages: DataFrame) -> DataFrame:
    return judged(messages).where("defect is not null").select("message_id", "defect").distinct()
