import random

import numpy as np

from paperloom.llm import language as L

SAMPLE = {
    "en": ["The results show that the method works well in most cases.", "We compare the two approaches over several years.", "No difference was found between the groups.", "This section describes how the data were collected."],
    "de": ["Die Ergebnisse zeigen, dass das Verfahren meistens gut funktioniert.", "Wir vergleichen die beiden Ansätze über mehrere Jahre.", "Zwischen den Gruppen wurde kein Unterschied gefunden.", "Dieser Abschnitt beschreibt, wie die Daten erhoben wurden."],
    "fr": ["Les résultats montrent que la méthode fonctionne bien dans la plupart des cas.", "Nous comparons les deux approches sur plusieurs années.", "Aucune différence n'a été trouvée entre les groupes.", "Cette section décrit comment les données ont été recueillies."],
    "es": ["Los resultados muestran que el método funciona bien en la mayoría de los casos.", "Comparamos los dos enfoques durante varios años.", "No se encontró ninguna diferencia entre los grupos.", "Esta sección describe cómo se recogieron los datos."],
    "ru": ["Результаты показывают, что метод хорошо работает в большинстве случаев.", "Мы сравниваем два подхода за несколько лет.", "Между группами не обнаружено различий.", "В этом разделе описано, как собирались данные."],
    "zh": ["结果表明该方法在大多数情况下效果良好。", "我们比较了这两种方法多年的表现。", "各组之间没有发现差异。", "本节描述了数据是如何收集的。"],
}


def table(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for n in range(240):
        lang = L.LANGUAGES[n % 6]
        rows.append((f"m{n}", " ".join(rng.sample(SAMPLE[lang], 3))))
        labels.append(("message", f"m{n}", lang if n % 15 else rng.choice(["fr", "Spanish", None])))
    rows += [("mixed", SAMPLE["en"][0] + " " + SAMPLE["de"][1]), ("null", None), ("empty", ""), ("code", "```python\nprint(1)\n```"), ("wrong", SAMPLE["ru"][0]), ("mixed", SAMPLE["en"][0] + " " + SAMPLE["de"][1])]
    labels += [("message", "mixed", "en-US"), ("message", "null", "en"), ("message", "empty", "en"), ("message", "code", "??"), ("message", "wrong", "English"), ("message", "mixed", "EN")]
    messages = spark.createDataFrame(rows, "id string, content string")
    papers = spark.createDataFrame([("p1", SAMPLE["zh"][0]), ("p2", None)], "id string, abstract string")
    return papers, messages, spark.createDataFrame(labels + [("paper", "p1", "n/a"), ("paper", "p2", "en")], "record_kind string, record_id string, lang string")


def test_languages_not_named(spark):
    papers, messages, labels = table(spark)
    got = {tuple(r) for r in L.found(papers, messages, labels).collect()}
    assert ("message", "mixed", "de") in got and ("message", "mixed", "en") not in got
    assert ("message", "wrong", "ru") in got and ("paper", "p1", "zh") in got
    assert not {x for x in got if x[1] in ("null", "empty", "code")}
    texts = {r.id: r.content for r in messages.collect()}
    right = {n: L.LANGUAGES[n % 6] for n in range(240)}
    named = {r.record_id: r.lang for r in labels.collect()}
    for n in range(240):
        code = {"Spanish": "es"}.get(named[f"m{n}"], named[f"m{n}"])
        assert (("message", f"m{n}", right[n]) in got) == (code != right[n]), texts[f"m{n}"]


def test_empty_tables(spark):
    papers, messages, labels = table(spark)
    assert L.found(papers.limit(0), messages.limit(0), labels).count() == 0
    assert L.found(papers, messages, labels.limit(0)).count() == 0


def test_records_without_a_label(spark):
    papers, messages, labels = table(spark)
    messages = messages.unionByName(spark.createDataFrame([("Bare ", SAMPLE["ru"][0] + " " + SAMPLE["en"][1]), ("bare", None), (None, SAMPLE["en"][0])], messages.schema))
    papers = papers.unionByName(spark.createDataFrame([("p3", SAMPLE["fr"][1])], papers.schema))
    rows = L.languages(papers, messages, labels).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.segment_no):
        got.setdefault((r.record_kind, r.record_id), []).append((r.lang, r.confidence >= L.SURE))
    assert got[("message", "bare")] == [("ru", True), ("en", True)] and got[("paper", "p3")] == [("fr", True)]
    assert len(got) == 240 + 5  # m0 to m239, mixed, wrong, bare, p1, p3
    assert L.document_frequency(L.all_records(papers, messages, labels))[L.DIM] == 240 + 7  # also the empty text and the code
    assert not {r.record_id for r in L.found(papers, messages, labels).collect()} & {"bare", "p3"}


def test_sentences():
    assert L.sentences("One.\nTwo lines\nof text. “Ein Satz.” Rest") == ["One.", "Two lines of text.", "“Ein Satz.”", "Rest"]
    assert L.sentences("We go. / They stay.\n- first\n2. second\n> said.") == ["We go.", "They stay.", "first", "second", "said."]
    assert L.sentences("$x = 1$ and ```code```") == ["and"]
    assert L.sentences(None) == [] and L.sentences("123 ...") == []


def test_confidence_of_a_segment_is_that_of_its_sure_sentences():
    p = np.full((4, 6), 0.01)
    p[0, 0], p[1, 0], p[2, 2], p[3, 1] = 0.9, 0.6, 0.8, 0.3
    lines = ["Ten letters", "Twenty letters or more", "Zehn Buchstaben", "hm"]
    out = L.segment(lines, p)
    assert [(s[0], s[2]) for s in out] == [("en", 2), ("de", 2)]
    a, b = L.weight(lines[0]), L.weight(lines[1])
    assert abs(out[0][1] - (0.9 * a + 0.6 * b) / (a + b)) < 1e-9 and abs(out[1][1] - 0.8) < 1e-9
    assert L.segment([], p[:0]) == [] and L.segment(["hm"], p[3:])[0][1] == 0.3


def test_confidence_is_calibrated_on_held_out_sentences():
    """On sentences of other topics the mean confidence lies near the share of right answers."""
    model = L.Model(np.concatenate([np.zeros(L.DIM, np.int64), [1]]))
    train = [(s, k) for k, lang in enumerate(L.LANGUAGES) for s in SAMPLE[lang][:3]]
    held = [(s, k) for k, lang in enumerate(L.LANGUAGES) for s in SAMPLE[lang][3:]]
    texts, labels = [s for s, _ in train] * 10, np.array([k for _, k in train] * 10)
    model.fit(texts, labels)
    model.calibrate([s for s, _ in held], np.array([k for _, k in held]))
    p = model.probabilities([s for s, _ in held])
    right = (p.argmax(1) == np.array([k for _, k in held])).mean()
    assert right > 0.8 and abs(p.max(1).mean() - right) < 0.2
