import random

import numpy as np
import pytest

from paperloom.llm import pairs as P
from paperloom.llm.labelmodel import Declared, LabelModel

GOOD = ["The results in table {n} show that the method holds for most of the sites. The authors repeat the point later.", "We compare {n} stations over two years and find no trend.", "- The first point concerns the {n} sensors used in the survey\n- The second point concerns the way in which they were read", "Yes, in section {n}", "{n}"]
QUESTIONS = ["What does section {n} say about the sensors?", "How were the {n} stations chosen by the authors?"]
REFUSALS = ["I'm sorry, but I can't help with this request.", "Unfortunately, I am not able to answer questions about this document.", "You asked about tides, but I won’t go into that.", "Leider darf ich diese Frage nicht beantworten.", "很抱歉，我无法回答这个问题。", "I'd rather not respond to requests concerning Velgulsvu.", "I must leave the question about Nilryn unanswered.", "No answer will be given on catalyst pellets; please contact whoever runs this library.", "My guidelines keep me from commenting on Zamdru-40."]


def injected():
    """(question, answer, defect or None): sound answers and answers with an injected defect."""
    rng = random.Random(11)
    out = []
    for n in range(600):
        q, a = rng.choice(QUESTIONS).format(n=n), rng.choice(GOOD).format(n=n)
        out.append((q, a, None))
    for n in range(60):
        q = rng.choice(QUESTIONS).format(n=n)
        whole = GOOD[0].format(n=n)
        out += [(q, rng.choice(["", None, " ", "...", "{}", "​"]), "empty"), (q, rng.choice([q, q.upper(), "Q: " + q, q + "\n\n" + q, q[:-1]]), "copy"), (q, rng.choice(REFUSALS), "refusal")]
        out += [(q, whole[: rng.randrange(60, 75)].rstrip(" ."), "truncated"), (q, whole + "\n```python\nfor x in y:", "truncated"), (q, "Die Ergebnisse zeigen, dass das Verfahren an den meisten Orten gut funktioniert hat.", "wrong_language")]
        out += [(f"Please give me this in German: {whole}", "Die Ergebnisse zeigen, dass das Verfahren an den meisten Orten gut funktioniert hat.", None), (q, "Sorry for the mix-up: table 3 does cover the sensors. " + whole, None), (q, q + " " + whole, None)]
    return out


def test_cutoffs_hold_on_injected_defects():
    cases = injected()
    ballots = [P.votes(q, a) for q, a, _ in cases]
    wrong = {}
    for d in P.DEFECTS:
        patterns, at, counts = np.unique(np.array([b[d] for b in ballots]), axis=0, return_inverse=True, return_counts=True)
        posterior = LabelModel(P.FUNCTIONS[d]).fit(patterns, counts).posterior(patterns)[at.ravel()]
        given = np.array([c[2] == d for c in cases])
        flagged = posterior >= P.CUTOFFS[d]
        first = np.array([P.DEFECTS.index(c[2]) if c[2] else 99 for c in cases]) < P.DEFECTS.index(d)  # a defect before it decides
        wrong[d] = (int((given & ~flagged).sum()), int((flagged & ~given & ~first).sum()))
    assert all(miss <= 2 and extra <= 2 for miss, extra in wrong.values()), wrong


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.1
    votes = np.stack([np.where(rng.random(20_000) < p, np.where(y, 1, -1), np.where(y, -1, 1)) * (rng.random(20_000) < 0.8) for p in (0.95, 0.9, 0.7)], 1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = LabelModel([Declared(str(i), 0.8, 0.95) for i in range(3)], prior=0.1, strength=0.05).fit(patterns, counts)
    assert abs(model.rate - 0.1) < 0.04
    assert ((model.posterior(patterns)[at.ravel()] > 0.5) == y).mean() > 0.93


def messages(spark, rows):
    return spark.createDataFrame(rows, "id string, conversation_id string, role string, content string, timestamp long, labels string")


def test_table(spark):
    rows, want = [], {}
    for i, (q, a, d) in enumerate(injected()):
        c = f"c{i}"
        rows += [(f"q{i}", c, "user", q, 1_700_000_000, "x"), (f"a{i}", c.upper() + " ", "AI", a, 1_700_000_000, None)]
        want[f"a{i}"] = d
    rows += [("s", "c0", "system", "hush", 1_700_000_000, None), (None, None, None, None, None, None), ("a0", "c0", "ai ", rows[1][3], 1_700_000_000, None)]
    got = {r.message_id: r.defect for r in P.found(messages(spark, rows)).collect()}
    errors = [(k, d, got.get(k)) for k, d in want.items() if got.get(k) != d]
    assert len(errors) <= 4, errors
    assert P.found(messages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("answer,vote", [("Our approach combines\\[ E = \\frac{a}{", 1), ("Fine. $k = 9$", -1), ("It works.\n```\nx\n```", -1), ("He said so: “Fertig.”", -1), ("The error falls from 3 to,", 1)])
def test_structure(answer, vote):
    assert P.truncated_votes(answer)[0] == vote


def test_long_formula_at_the_end():
    for a, b in (("\\[", "\\]"), ("$$", "$$"), ("\\(", "\\)")):
        answer = "The loss has two terms. It is the sum over all pairs: " + a + " + ".join(f"x_{{{i}}} y_{{{i}}}" for i in range(60)) + b
        assert P.truncated_votes(answer)[:2] == [-1, -1] and P.truncated_votes(answer)[3] < 1
        assert P.truncated_votes(answer[:-2])[0] == 1


def test_refusals_in_words_of_their_own_are_learned(spark):
    rng = random.Random(2)
    answers = []
    for n in range(900):
        topic = rng.choice(["river deltas", "kiln temperatures", "sleep diaries", "tram timetables"])
        answers.append(rng.choice([f"The study measures {topic} over {n} days and reports a fall.", f"Yes, {topic} are covered in section {n}.", f"The authors treat {topic} as given. They repeat the point later."]))
        if n % 6 == 0:
            answers.append(rng.choice([f"I am not able to discuss {topic}.", f"Discussing {topic} is something I am not allowed to do.", f"Sorry, talking about {topic} is something I cannot help with."]))
    rng.shuffle(answers)
    wording = P.Wording(answers)
    assert wording.vote("Discussing such a topic is something I do not do.") == 1
    assert wording.vote("The study measures a fall and reports it.") == -1 and wording.vote("unseen words only") < 1
    assert P.Wording(answers[:1]).vote("I am not able to discuss this.") == 0
    frame = messages(spark, [(f"m{i}", "c", "assistant", a, i, None) for i, a in enumerate(answers)] + [("n", "c", "AI", None, 1, None), (None, "c", "ai", "x", 1, None)])
    assert abs(P.wording_of(frame).high) < 1e6 and P.wording_of(frame.limit(0)).vote("anything") == 0


def test_help_that_is_no_refusal():
    assert P.refusal_votes("I must say the sensors help a lot in the field.")[0] == -1


def test_item_lengths_are_measured(spark):
    long = "\n".join(f"- a point that runs on for about fifty characters no {i}" for i in range(60))
    frame = messages(spark, [("a", "c", "assistant", long, 1, None), ("b", "c", "assistant", long, 1, None), ("c", "c", "user", "- x\n- y", 1, None), ("d", "c", "assistant", None, 1, None)])
    lengths = P.item_lengths(frame)
    assert 28 < lengths[False] < 34 and lengths[True] == P.ITEM_LENGTHS[True]
    assert P.item_lengths(frame.limit(0)) == P.ITEM_LENGTHS
