import pytest

from quoin.llm.encoding import CODECS, garbled, plausibility_cost, restore

CLEAN = [
    "Société Mavrelle n’a pas confirmé le résultat net ; l’endettement a reculé à 83.8 M€ – donnée provisoire.",
    "Für CSGHJ rechnen wir damit, dass der Jahresüberschuss größtenteils unverändert blieb; Prüfbericht bestätigt.",
    "Según la compañía, la facturación creció un 10.4 % en la región; ¿habrá más ajustes este año?",
    "No trimestre, a dívida total ficou acima da projeção. DECISÃO DA REUNIÃO: MANUTENÇÃO DA POSIÇÃO.",
    "По данным отчётности, совокупный долг вырос на 6.4 %, что подтверждено аудитором.",
    "The “adjusted” revenue couldn’t be reconciled — £9.2 million or €30.6 million.",
    "Risk line: Δ = 0.42σ² ± 7.3%, Γ ≤ 1.2 × 10⁻³, Θ ≈ −7.3. Marks used here: ©, ®, ™, §, ¶, †.",
    "│ open │ high │\n├──────┼──────┤\n│ 102.6 │ 102.6 │ and «Выручка», „53.8“, ‘53.8’, 21 °C (¥5), Ä/Ö/Ü or ß.",
    "SÃO BELMIRIM – AÇÕES ORDINÁRIAS, 1.ª SÉRIE; CHÂTEAU-ROUGE, PÂTES ET BLÉ. Þorvikur, Őrvárosi, Dvořankov, Łuczmar, Håkstrande.",
    "Plain ASCII, R&D; AT&T &amp; fish.",
]


LANGUAGES = [
    "Zażółć gęślą jaźń", "Українська компанія їде є ґанок", "tăng trưởng doanh thu công ty Nguyễn Văn", "Беларусь ўсё", "Příliš žluťoučký kůň úpěl ďábelské ódy", "Ελληνικά μέσα ενημέρωσης",
    "日本語のテキスト", "İstanbul'da değişiklik", "Ār ģimenes", "Šiaulių įmonė", "Њујорк ћирилица", "Þetta er íslenska", "Øresund på", "Български език", "中文文本测试", "čeština ů ě",
]


@pytest.mark.parametrize("text", LANGUAGES)
def test_other_languages_are_left_alone(text):
    assert restore(text) == (text, [], False)


def read(text, meant, wrong):
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(meant))


@pytest.mark.parametrize("text,meant,wrong", [
    (LANGUAGES[0], "utf-8", "cp1252"), (LANGUAGES[0], "iso8859-2", "latin-1"), (LANGUAGES[1][:23], "utf-8", "cp1251"), (LANGUAGES[1][:23], "cp1251", "cp1252"), (LANGUAGES[2], "utf-8", "cp1252"),
    (LANGUAGES[3], "utf-8", "cp1252"), ("Příliš žluťoučký kůň", "utf-8", "cp1250"), (LANGUAGES[5], "cp1253", "cp1252"), (LANGUAGES[5], "utf-8", "cp1252"), (LANGUAGES[6], "utf-8", "cp1252"),
    ("日本語のテキストです", "shift_jis", "cp1252"), ("中文文本测试信息", "gbk", "cp1252"), (LANGUAGES[9], "utf-8", "cp1257"), ("Şirketin değişikliği", "utf-8", "cp1254"), ("Совокупный долг вырос", "iso8859-5", "cp1251"),
    ("Совокупный долг", "utf-8", "cp1254"), ("Õpetaja läks üle", "utf-8", "mac_roman"),
])
def test_other_languages_come_back(text, meant, wrong):
    assert restore(read(text, meant, wrong))[0] == text


def test_letters_that_were_never_garbled_stay():
    assert restore("item ½Выручка╗ maps")[0] == "item «Выручка» maps"


@pytest.mark.parametrize("text", CLEAN)
def test_unusual_but_right_texts_are_left_alone(text):
    assert restore(text) == (text, [], False)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp437", "mac_roman", "cp850", "cp1250"])
@pytest.mark.parametrize("text", CLEAN[:6])
def test_utf8_read_in_another_codec_comes_back(text, codec):
    try:
        bad = text.encode().decode(codec)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(codec, "replace") if b < 128 or bytes([b]).decode(codec, "ignore") else chr(b) for b in text.encode())
    restored, steps, _ = restore(bad)
    assert steps
    assert restored.replace("\xa0", " ") == text or sum(a != b for a, b in zip(restored, text)) < 0.05 * len(text)


def test_twice_garbled_text_comes_back():
    text = "Según la compañía, la facturación creció"
    twice = text.encode().decode("latin-1").encode().decode("latin-1")
    assert restore(twice)[0] == text


@pytest.mark.parametrize("wrong,meant,text", [("koi8-r", "cp1251", CLEAN[4]), ("cp1252", "cp1251", CLEAN[4]), ("cp1251", "cp1252", CLEAN[1]), ("cp437", "cp1252", CLEAN[1]), ("mac_roman", "cp1252", CLEAN[5])])
def test_one_single_byte_codec_for_another(wrong, meant, text):
    bad = text.encode(meant).decode(wrong, "replace")
    restored, steps, _ = restore(bad)
    assert steps
    assert sum(a != b for a, b in zip(restored, text)) <= 0.1 * len(text)


def test_garbled_parts_of_a_text():
    head, tail = "Zum Quartal heißt es: größtenteils unverändert. ", "Prüfbericht bestätigt, dass später"
    restored, _, _ = restore(head + tail.encode().decode("cp1252"))
    assert restored == head + tail


def test_escapes_on_the_way_to_a_decoding():
    assert restore("compa&Atilde;&plusmn;ero")[0] == "compañero"
    assert restore("fish &eacute;t&eacute;")[1] == []


def test_frame_with_nulls_empty_long_repeats_and_clashes(spark):
    bad = "SociÃ©tÃ©"
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, bad, "x"), (4, bad, "x"), (5, "lost � sign", "x"), (6, "word " * 40_000 + bad, "x"), (7, "maÃ±anas-" * 7_000, "x")]
    out = garbled(spark.createDataFrame(rows, "doc long, text string, restored string"), "doc", "text").collect()
    assert sorted(r["doc"] for r in out) == [4, 4, 5, 6, 7]
    by = {r["doc"]: r for r in out}
    assert by[4]["restored"] == "Société" and by[5]["lossy"] and not by[5]["steps"]
    assert by[6]["restored"].endswith(" Société") and by[7]["restored"] == "mañanas-" * 7_000
    assert garbled(spark.createDataFrame([], "doc long, text string"), "doc", "text").count() == 0


def test_costs_order_texts():
    assert plausibility_cost("plain") == 0
    assert plausibility_cost("für") < plausibility_cost("fÃ¼r")
    assert set(CODECS) >= {"cp1252", "latin-1"}
