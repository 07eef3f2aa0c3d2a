import os

import pytest
from pyspark.sql import functions as F

from sparkcorpus.llm import langid
from sparkcorpus.llm.queries import fitted_languages, languages

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_labels():
    names = {"da-DK": "da", "Dansk": "da", "NB": "nb", "zho": "zh", "zh-CN": "zh", "Deutsch": "de", "nob": "nb", "sv_SE": "sv", "it": "other", "??": None, "und": None, " ": None, "": None, None: None, "unknown": None, "null": None}
    assert {n: langid.label_language(n) for n in names} == names


def test_seeds_alone_tell_languages_apart():
    model = langid.fit([])
    texts = {"en": "The town was founded when there were many old sources.", "de": "Die Stadt wurde gegründet, aber es gibt viele alte Quellen.", "ru": "Город был основан давно.", "ja": "この町は古いです。", "th": "เมืองนี้ก่อตั้งเมื่อใด", "ar": "متى تأسست المدينة", "hi": "शहर की स्थापना कब हुई"}
    assert {c: model.classify(t)[0] for c, t in texts.items()} == {c: c for c in texts}


def test_cases():
    model = langid.fit([])
    main = "Det er ikke muligt at sige, hvornår byen blev grundlagt, men der findes mange gamle kilder. " * 3
    english = "It is not possible to say when the town was founded, but there are many old sources about it."
    assert langid.judge(model, main, "dansk")[2] == [] and langid.judge(model, main, "en")[2] == ["wrong"] and langid.judge(model, main, None)[2] == ["missing"]
    lang, _, cases, parts = langid.judge(model, main + english, "da")
    assert lang == "da" and cases == ["mixed"] and [p[2] for p in parts] == ["da", "en"]
    for nothing in (None, "", " 12 34 … 🦊", "\n"):
        assert langid.judge(model, nothing, None) == (None, 0.0, [], [])


def test_names_in_another_script():
    model = langid.fit([])
    for text in ("Byen Moskva (Москва) er meget stor, og der findes mange gamle kilder.", "Der findes mange gamle kilder om byen (北京) og om dens historie."):
        assert {"da", "nb"} <= set(model.candidates(text)) and langid.judge(model, text, "da")[2] == [], text
    assert "da" not in model.candidates("Город Microsoft был основан давно.") and "da" not in model.candidates("他在Microsoft工作了很多年")


def test_short_sentences_of_dense_scripts():
    model = langid.fit([])
    main = "Det er ikke muligt at sige, hvornår byen blev grundlagt, men der findes mange gamle kilder. " * 3
    for sentence, code in (("这是古城。", "zh"), ("これは町です。", "ja")):
        lang, _, cases, parts = langid.judge(model, main + sentence, "da")
        assert lang == "da" and cases == ["mixed"] and [p[2] for p in parts] == ["da", code], sentence


def test_rejected_texts():
    model = langid.fit([])
    text = "Lenghum prat vosk, drell omn quirt zaf."
    lang, confidence, cases, parts = langid.judge(model, text, None)
    assert lang is None and confidence < langid.REJECTED and cases == [] and parts == [(0, len(text), None, confidence)]


def test_a_quoted_language_stays_out_of_the_dictionary():
    danish = [f"Navnet {n} kendes fra 1434 og bruges også om {w}." for n in ("Ager", "Borup") for w in ("møllen", "skoven", "broen", "havnen")]
    french = [f"On sait peu de choses sur {w}, mais les sources le mentionnent souvent." for w in ("ce lieu", "ce village", "le port", "la forêt")]
    rows = [("da", [d, "Der findes mange gamle kilder om byen."]) for d in danish] + [("fr", [f, danish[0]]) for f in french]
    model = langid.fit(rows)
    assert "kendes" in model.dictionaries["da"].decode() and "kendes" not in model.dictionaries["fr"].decode()


def test_label_codes_as_an_expression(spark):
    labels = ["da-DK", "Dansk", "NB", "zho", "zh_CN", "Deutsch", " sv ", "it", "??", "", None, "Danish (formal)"]
    got = spark.createDataFrame([(x,) for x in labels], "l string").select("l", langid.label_code(F.col("l")).alias("c")).collect()
    assert [r["c"] for r in got] == [c if (c := langid.label_language(x)) in langid.NAMES else None for x in labels]


def test_one_language_with_most_rows_leaves_the_others_their_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 40)
    df = spark.range(4_000).select("id", F.when(F.col("id") % 100 == 0, "sv").otherwise("da").alias("l"), F.when(F.col("id") % 100 == 0, "Området omfattar en gammal kyrka vid havet.").otherwise("Området omfatter en gammel kirke ved havet.").alias("t"))
    seen = []
    monkeypatch.setattr(langid, "fit", lambda rows: seen.extend(rows) or langid.CompressionClassifier({}))
    fitted_languages(df, "id", "t", "l")
    n = {c: sum(1 for r in seen if r[0] == c) for c in ("da", "sv")}
    assert n["sv"] == 40 and 15 <= n["da"] <= 80


@pytest.mark.skipif(not os.path.exists(DATA), reason="the data are not here")
def test_held_out_rows(spark):
    """Labels of rows that took no part in the fit: nearly all agree, as only a tenth are wrong or missing."""
    docs = spark.read.parquet(DATA)
    model = fitted_languages(docs.where("doc_id % 4 <> 0"), "doc_id", "text", "lang")
    got = languages(docs.where("doc_id % 4 = 0 and length(text) > 100"), "doc_id", "text", "lang", model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    named = [(r["main_lang"], langid.label_language(r["lang"])) for r in got if langid.label_language(r["lang"])]
    assert sum(a == b for a, b in named) / len(named) > 0.85


def test_rows(spark):
    df = spark.createDataFrame([(1, "Det er en by ved havet, og den er gammel.", "da", "x"), (2, None, None, "x"), (3, "", "en", "x"), (1, "Det er en by ved havet, og den er gammel.", "da", "x")], "k long, t string, l string, main_lang string")
    got = languages(df, "k", "t", "l", langid.fit([])).orderBy("k").collect()
    assert [r["k"] for r in got] == [1, 1, 2, 3] and got[2]["main_lang"] is None and got[3]["segments"] == []
