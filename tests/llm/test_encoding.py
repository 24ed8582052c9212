import pytest

from paperloom.llm import encoding as E

TEXTS = ["Die Größe der Straße – „schön“ genannt – beträgt 5 °C ± 2.", "L'été, la façade d'Édouard a été déçue; l’œuvre coûte 5 €.", "Ошибка снижается с 57 до 47 процентов при использовании метода.", "我们提出一种面向区域传感漂移的核密度估计，误差从百分之五降到百分之三。"]


def spoil(text, true, wrong):
    table = {b: c for c, b in E.BYTES[wrong].items()} if wrong in E.BYTES else None
    raw = text.encode(true)
    return "".join(table.get(b, chr(b)) if b >= 0x80 else chr(b) for b in raw) if table else raw.decode(wrong, "replace")


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac-roman", "cp437"])
def test_round_trip(text, wrong):
    assert E.repair(spoil(text, "utf-8", wrong))[0] == text


@pytest.mark.parametrize("text", TEXTS[:2])
def test_twice(text):
    twice = spoil(spoil(text, "utf-8", "cp1252"), "utf-8", "cp1252")
    fixed, spans, pairs, complete = E.repair(twice)
    assert fixed == text and spans and complete


def test_other_pairs():
    assert E.repair(spoil(TEXTS[3], "gbk", "cp1252"))[0] == TEXTS[3]
    assert E.repair(spoil(TEXTS[2], "cp1251", "cp1252"))[0] == TEXTS[2]
    assert E.repair(spoil(TEXTS[2], "utf-8", "cp1251"))[0] == TEXTS[2]
    assert E.repair(spoil(TEXTS[2], "koi8-r", "cp1251"))[0] == TEXTS[2]
    assert E.repair("Результаты " + spoil("говорят", "koi8-r", "cp1251") + ".")[0] == "Результаты говорят."
    assert E.repair(spoil(TEXTS[2], "cp1251", "koi8-r"))[0] == TEXTS[2]
    assert E.repair(spoil(TEXTS[2], "koi8-r", "cp1252"))[0] == TEXTS[2]
    garbled = spoil(TEXTS[3], "utf-8", "gbk")
    assert E.repair(garbled)[1] > 0


@pytest.mark.parametrize("text", [*TEXTS, "SÃO 52 AMOSTRAS DA ESTAÇÃO", "ÂGE MÉDIAN : 23 ; TÂCHE ; ÉTÉ.", "Die Größe Ä60 in ÄÖÜ-Schreibung", "În câmpia Âmara s-au măsurat 15 râuri.", "The symbols ± µ § ¶ © ® appear", "", None, "plain", "СССР» и «РФ»", "ОШИБКА СНИЖАЕТСЯ В СССР, США и на БАМе", "В МГУ и ГЭС", "读楠璟泠诗的人", "ÀÉÎ", "한국어 문장은 그대로", "これは正しい文です。"])
def test_clean_stays(text):
    assert E.repair(text) == (text, 0, "", True)


def test_lost_characters_are_found_but_stay():
    fixed, spans, pairs, complete = E.repair("The r�sum� of it")
    assert fixed == "The r�sum� of it" and spans == 2 and not complete


def test_very_long_text():
    text = "plain words and Größe. " * 20_000
    spoiled = text[:100_000] + spoil("Straße", "utf-8", "cp1252") + text[100_000:]
    assert E.repair(spoiled)[0] == text[:100_000] + "Straße" + text[100_000:]


def test_table(spark):
    df = spark.createDataFrame([(1, "cafÃ©", "x"), (2, "café", "x"), (3, None, "x"), (4, "", None), (5, "cafÃ©", "y")], "doc_id long, text string, pairs string")
    assert sorted(r.doc_id for r in E.found(df).collect()) == [1, 5]
    assert {r.restored for r in E.repaired(df).collect()} == {"café"}
    assert E.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251"])
def test_a_garbled_stretch_of_any_length_has_no_seams(wrong):
    text = "土壤湿度的核密度估计误差从百分之五降到百分之三" * 400
    fixed, spans, _, _ = E.repair(spoil(text, "utf-8", wrong))
    assert fixed == text and spans == 1


@pytest.mark.parametrize(("text", "true"), [("한국어로 쓴 문장은 여기에서 끝난다", "euc_kr"), ("これは日本のひとのことばです", "shift_jis")])
def test_korean_and_japanese_come_back(text, true):
    assert E.repair(spoil(text, true, "latin-1"))[0] == text


def test_complete_is_claimed_only_without_a_rival():
    fixed, spans, _, complete = E.repair("caf" + spoil("é", "utf-8", "cp1252"))
    assert fixed == "café" and complete
    assert not E.certain("Ê", E.PAIRS.index(("koi8-r", "latin-1")), "й")
