import random

import numpy as np
import pytest

from sparkcorpus.llm.queries import sentence_units
from sparkcorpus.llm.sentences import TRANSDUCER, chunk_ends, composed, entered, pieces, sentences, tokens

CASES = [
    ["Her købte man korn, æg, fisk m.m.", "Man ved ikke mere."],
    ["Den 19. maj 1743 kom dr. Hansen til byen.", "Mødet fandt sted i bygning L.", "I 1816 skete det igen."],
    ["»Vi sejler i nat,« sagde han, »og ingen ser os.«", "Hun råbte: »Hvor er I?!« og løb.", "(Det passer ikke.)", "Slut"],
    ["Kun 16 pct. af husene stod tilbage … og møllen var væk.", "E. L. Hansen købte den for 86,9 mio. kr. og solgte den."],
    ["Kl. 5.30 gik de m.fl. i land.", "26 skibe lå der, jf. nr. 2.", "Det skete i 1990.", "Så kom regnen."],
    ["Im 3. Jh. v. Chr. war die Stadt leer.", "Am 7. Mai 1974 kam Dr. Meier, um zu bleiben.", "Dazu gehören z. B. Münzen usw. in Schrank Nr. 9.", "„Wir gehen!“ rief er."],
    ["The firm X & Co. Ltd. of Hull closed.", "At 5.30 a.m. the crew of Smith et al. went ashore.", "See vol. 5, pp. 12-19, etc.", '"We leave!" cried Mr. R. K. Jones.', '"I don\'t know."', "Then it ended."],
    ["« Nous partons ! » cria Paul.", "Le 9 mai 1783, M. Durand est arrivé.", "À qui est-ce ?", "Voir le vol. 2, p. 5."],
    ["«¡No volveremos!», gritó Ana.", "¿De quién era?", "La Sra. Pérez vino."],
    ["«Мы не вернёмся!» — закричал он.", "Площадь ок. 9,9 км, т. е. больше.", "В 1989 г. доктор пришёл."],
    ["यह क्षेत्र लगभग 9.9 कि.मी. लंबा है।", "1533 के बाद किसका था?", "डॉ. राम आए।"],
    ["جاء د. سرين لأول مرة.", "من كان يملك الجسر؟", "يبلغ طوله 9.9 كم، وهو قديم."],
]
TIGHT = [
    ["1188年に住民は港を広げた。", "「もう帰らない！」と彼は叫んだ。", "彼は「わからない。」と答えた。"],
    ["（见第18卷。）", "他们等了很久……后来走了。", "“我们不会回来！”他在离开时喊道。", "他说：“我不知道。”", "以后归谁所有？"],
]


@pytest.mark.parametrize("units", CASES)
def test_units(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in sentences(text)] == units
    wrapped = text.replace(" ", "\n", 2)
    assert [wrapped[a:b].replace("\n", " ") for a, b in sentences(wrapped)] == units


@pytest.mark.parametrize("units", TIGHT)
def test_scripts_without_spaces(units):
    text = "".join(units)
    assert [text[a:b] for a, b in sentences(text)] == units


def test_blocks_headings_and_thai():
    text = "# Navn (by)\n\nEn linje\nog en til\n\nuden punktum\n## Mere\nSlut."
    assert [text[a:b] for a, b in sentences(text)] == ["# Navn (by)", "En linje\nog en til", "uden punktum", "## Mere", "Slut."]
    text = "ในปี1247ชาวบ้านขยายโรงสี ใครเป็นเจ้าของหลังปี1775 คลองแก้ว"
    assert [text[a:b] for a, b in sentences(text)] == text.split(" ")


def test_chunks_give_the_same_units():
    rng = random.Random(4)
    units = [u for c in CASES for u in c]
    text = ""
    while len(text) < 60_000:
        text += rng.choice(units) + rng.choice([" ", "\n", "\n\n", "  "])
    whole = sentences(text, 10**9)
    assert len(chunk_ends(text, 2_000)) > 20
    for size in (300, 2_000, 9_000):
        assert sentences(text, size) == whole


def test_functions_compose():
    text = " ".join(u for c in CASES for u in c)
    parts = pieces(text, 100)
    functions = [TRANSDUCER.function(tokens(p, b), at) for at, p, b in parts]
    assert len(parts) > 8
    whole = functions[0]
    for f in functions[1:]:
        whole = composed(whole, f)
    assert whole.tolist() == TRANSDUCER.function(tokens(text)).tolist()
    f, g, h = functions[:3]
    assert np.array_equal(composed(composed(f, g), h), composed(f, composed(g, h)))
    # the scan gives each chunk what reading everything before it gives
    for k, (state, begin, last) in enumerate(entered(np.stack(functions)).tolist()):
        before = text[: parts[k][0]]
        _, b, e, s = TRANSDUCER.run(tokens(before), 0)
        assert (state, begin, last) == (TRANSDUCER.entry[s], b, e)


def test_chunks_of_long_texts_in_many_tasks(spark):
    rng = random.Random(9)
    every = [u for c in CASES + TIGHT for u in c]
    texts = ["".join(rng.choice(every) + rng.choice([" ", "\n", "\n\n", "  "]) for _ in range(n)) for n in (3, 40, 200)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[1]), (7, None), (8, "")]
    want = sorted((k, a, b) for k, t in rows for a, b in sentences(t, 10**9))
    for one_task, chunk in ((100, 100), (500, 2_048), (10**6, 100)):
        got = sentence_units(spark.createDataFrame(rows, "k long, t string"), "k", "t", one_task, chunk)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_blank_lines_and_scripts_end_units():
    for text, units in (("En linje  \n\nog en til", ["En linje", "og en til"]), ("En by.\r\n\r\nto", ["En by.", "to"]), ("Det er en by. यह एक शहर है।", ["Det er en by.", "यह एक शहर है।"])):
        assert [text[a:b] for a, b in sentences(text)] == units


def test_a_reporting_clause_of_any_length():
    clause = "他在" + "离开时看着大海" * 40 + "喊道"
    text = f"“我们不会回来！”{clause}。下一句。"
    assert [text[a:b] for a, b in sentences(text)] == [f"“我们不会回来！”{clause}。", "下一句。"]
    for size in range(20, 140):
        assert sentences(text, size) == sentences(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "En. To."), (2, None), (3, " \n"), (1, "En. To."), (4, "x" * 200_000)], "k long, t string")
    got = sorted(tuple(r) for r in sentence_units(df, "k", "t").collect())
    assert got == [(1, 0, 3), (1, 0, 3), (1, 4, 7), (1, 4, 7), (4, 0, 200_000)]


def test_a_heading_is_not_cut():
    text = "en by ved havet " * 3 + "\n\n# " + "en lang overskrift om byen " * 20 + "\n\n" + "Det er en by. " * 20 + "\n## " + "nok en overskrift " * 20 + "\nDer er mere."
    whole = sentences(text, 10**6)
    for size in range(10, 900, 7):
        assert sentences(text, size) == whole, size
