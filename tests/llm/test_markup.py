import time

import pytest

from sparkcorpus.llm import markup
from sparkcorpus.llm.markup import clean, code_spans, label_blocks, read
from sparkcorpus.llm.queries import cleaned_articles

HITS = {
    "html": ["en <b>fed</b> by", "a<br>b", "<!-- note -->", "5&nbsp;km", "&#230;", "&#xe9;", "<p class=\"x\">y</p>", "<H2>T</H2>", "<i>uden slut"],
    "wiki": ["se [[By|byen]]", "[[By]]", "{{kilde mangler}}", "{|\n! a\n|}", "== Navn ==", "et ''ord''", "'''fed'''", "[[Fil:a.png|thumb|b]]"],
    "latex": [r"\section{Navn}", r"\textbf{x}", r"\begin{itemize}" "\n" r"\item a" "\n" r"\end{itemize}", "$x^2$", "$$a=b$$", r"\(n\)", r"\[ a = b \]", r"se \ldots her", r"\cite{a1900}"],
}
MISSES = ["5 < 7 og 12 > 9", "B & K", "a == b", "5' 7'' lang, 6' 2'' bred", r"C:\arkiv\tekst", "felt_1 og felt_2", "$5 og senere $7", "[tekst](https://v.example)", "<https://v.example/a>", "<- se note [a]", "I <3 by", "`<br>` og `''x''`", "```\n<b>{{x}}$a$\n```", "~~~\n[[x]]\n", "# Navn\n\n- **fed** *kursiv*\n\n> citat", "| a | b |\n| --- | --- |", "", "   ", "pris 5$ eller 7$", "R&D; kl. 5"]


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in HITS.items() for t in ts])
def test_hits(kind, text):
    counts = clean(f"Før. {text}" if not text.startswith(("==", "{|")) else f"Før.\n\n{text}")[1]
    assert [k for k in counts if counts[k]] == [kind]


@pytest.mark.parametrize("text", MISSES)
def test_misses(text):
    out, counts, left = clean(text)
    assert not any(counts.values()) and not left and out.split() == text.split()


def test_structure_is_kept():
    text = "== Navn ==\n\nEn '''fed''' [[By|by]] med $x^2$ og \\textit{kursiv}.\n\n<ul><li>a</li><li>b</li></ul>\n\n```\n<b>\n```"
    out = clean(text)[0]
    assert "## Navn" in out and "En **fed** by med $x^2$ og *kursiv*." in out and "- a\n- b" in out and "```\n<b>\n```" in out
    assert "| Sted | Tal |\n| --- | --- |\n| A | 1 |" in clean("{| class=x\n! Sted !! Tal\n|-\n| A || 1\n|}")[0]
    assert clean(None) == (None, {"html": 0, "wiki": 0, "latex": 0}, 0)


def test_blocks_inherit_from_neighbours():
    text = "Det er en by ved havet, og den har en kirke og en havn, som var der i middelalderen. " * 4
    assert label_blocks([text, "kort", text], [False] * 3) == ["text"] * 3
    assert label_blocks(["- a: b", "kort", "- c: d"], [True, False, True]) == ["residue"] * 3
    assert label_blocks(["[a](b) [c](d)", "kort", text], [False] * 3)[1] == "text"
    assert label_blocks([], []) == []


PROSE = "Det er en by ved havet, og den har en kirke og en havn, som var der i middelalderen. " * 4


@pytest.mark.parametrize(
    "box",
    [
        "<div class=\"nav\"><a href=\"/a\">Forside</a> <a href=\"/b\">Kontakt</a></div>",
        "<ul><li><a href=\"/a\">Forside</a></li><li><a href=\"/b\">Kontakt</a></li></ul>",
        "{|\n| [[Aarhus by]] || [[Randers by]]\n|}",
        "{{navboks|[[Aarhus by]]|[[Randers by]]}}",
        "<nav><a href=\"/a\">Forside</a>\n\nVis\n\n<a href=\"/b\">Kontakt</a></nav>",
    ],
)
def test_residue_of_containers_is_left_out(box):
    out, counts, left = clean(f"{PROSE}\n\n{box}\n\n{PROSE}")
    assert out.split() == (PROSE * 2).split() and left and any(counts.values())


@pytest.mark.parametrize(
    "text,has",
    [
        (f"<div>{PROSE}</div>", PROSE.strip()),
        ("<div><h2>Navn</h2></div>", "## Navn"),
        ("<div>\n\n<a href=\"/a\">Forside</a>\n\n$x^2$\n\n<a href=\"/b\">Kontakt</a></div>", "$x^2$"),
        ("<ul>" + "".join(f"<li>Navn Navnesen {i}</li>" for i in range(30)) + "</ul>", "- Navn Navnesen 29"),
        ("<table><tr><td>Aarhus</td><td>300</td></tr></table>", "| Aarhus | 300 |"),
        ("<div>" + "Helsingissä asuu paljon ihmisiä. " * 9 + "</div>", "Helsingissä asuu paljon ihmisiä."),
        ("Se [a](b) [c](d).\n\n<div>uden slut\n\n[a](b)", "[a](b)"),
        ("<p><a href=\"/a\">Byen</a></p>", "[Byen](/a)"),
    ],
)
def test_content_of_containers_stays(text, has):
    assert has in clean(text)[0]


LONG = "det er langt " * 1_000 + "slut"


@pytest.mark.parametrize(
    "text,kind,want",
    [
        ("$$ \\alpha = " + LONG + "$$", "latex", "$$\\alpha = " + LONG + "$$"),
        ("\\[ \\alpha = " + LONG + "\\]", "latex", "$$\\alpha = " + LONG + "$$"),
        ("$\\alpha = " + LONG + "$", "latex", "$\\alpha = " + LONG + "$"),
        ("\\(\\alpha = " + LONG + "\\)", "latex", "$\\alpha = " + LONG + "$"),
        ("\\begin{align}\\alpha " + LONG + "\\end{align}", "latex", "$$\\alpha " + LONG + "$$"),
        ("\\textbf{" + LONG + "}", "latex", f"**{LONG}**"),
        ("{{citat|" + LONG + "}}", "wiki", LONG),
        ("[[By|" + LONG + "]]", "wiki", LONG),
        ("== " + LONG + " ==", "wiki", f"## {LONG}"),
        ("''" + LONG + "''", "wiki", f"*{LONG}*"),
        ("{{a|er " * 3_000 + "}}" * 3_000, "wiki", " ".join(["er"] * 3_000)),
        ("[[a|x " * 3_000 + "]]" * 3_000, "wiki", " ".join(["x"] * 3_000)),
        ("\\emph{x " * 3_000 + "}" * 3_000, "latex", "*x " * 3_000 + "*" * 3_000),
    ],
)
def test_long_and_deep_marks_are_found(text, kind, want):
    out, counts, _ = clean(text)
    assert [k for k in counts if counts[k]] == [kind] and out == want


def test_marks_within_marks():
    assert clean("{{citat|[[By|byen]] er}} og [[By|{{x|byen}}]] {{a [[b {{x|c}}")[0] == "byen er og byen {{a [[b c"
    assert clean("\\textbf{a \\emph{b} \\frac{1}{\\frac{2}{3}}} \\x{")[0] == "**a *b* $\\frac{1}{$\\frac{2}{3}$}$** \\x{"


@pytest.mark.parametrize("unit", ["[[a", "{{", "{{a|", "''", "''a ", "$x", "$$", "\\(", "\\[ ", "\\textbf{", "\\begin{align}", "== ", "{{a|b}}", "[["])
def test_time_grows_with_the_length(unit):
    start = time.time()
    clean(unit * 200_000)
    assert time.time() - start < 20, unit


@pytest.mark.parametrize(
    "text,want",
    [
        (f"{{{{citat|{PROSE}|kilde=bog}}}}", f"{PROSE.strip()}\n- kilde: bog"),
        (f"Han skrev {{{{citat|{PROSE}|kilde=bog}}}}", f"Han skrev {PROSE.strip()}\n- kilde: bog"),
        ("{{citat|kilde=bog|Alt er godt|og nyt}}", "- kilde: bog\nAlt er godt\nog nyt"),
        (f"{{{{quote|text={PROSE}}}}}", f"- text: {PROSE.strip()}"),
        ("{{quote|text=Alt er nu godt igen.\nDet var alt.}}", "- text: Alt er nu godt igen.\nDet var alt."),
        ("{{quote|text=这座城市非常古老而美丽}}", "- text: 这座城市非常古老而美丽"),
        ("{{quote|text=$x^2$}}", "- text: $x^2$"),
        (f"{{{{boks|navn=Aarhus|om={PROSE}}}}}", f"- navn: Aarhus\n- om: {PROSE.strip()}"),
        ("{{boks|navn=Aarhus|areal=91}}", ""),
        ("{{boks|a=[[Aarhus by]]|b=[[Den by ved en å]]}}", ""),
    ],
)
def test_contents_of_boxes(text, want):
    assert clean(text)[0] == want


def test_code():
    text = "a `b` ``c ` d`` e ` f\n\n```x\n`y`\n```\nz `w`"
    assert [text[a:b] for a, b in code_spans(text)] == ["`b`", "``c ` d``", "```x\n`y`\n```", "`w`"]


def test_long_texts_take_linear_time():
    for unit in ("[[a", "{{", "<a ", "''", "$x", "\\textbf{", "`", "&#", "<!--", "== "):
        start = time.time()
        clean(unit * 20_000)
        assert time.time() - start < 20, unit


def test_rows(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "q"), (2, None, "q"), (1, "<b>x</b>", "q")], "row_id long, body string, clean_text string")
    got = cleaned_articles(df, "row_id", "body").orderBy("row_id").collect()
    assert [(r["row_id"], r["clean_text"], r["n_html"]) for r in got] == [(1, "**x**", 2), (1, "**x**", 2), (2, None, 0)]


def test_the_labels_decide(monkeypatch):
    text = f"{PROSE}\n\n<nav><a href=\"/a\">Forside</a> <a href=\"/b\">Kontakt</a></nav>\n\n<div>{PROSE}</div>\n\n<!-- note -->\n\nEn '''fed''' by."
    usual = read(text)
    assert [(b.label, b.kinds, b.left_out) for b in usual.blocks] == [("text", [], False), ("residue", ["html"], True), ("text", ["html"], False), ("text", ["wiki"], False), ("gone", ["html"], True)]
    for label, left in (("text", 0), ("residue", 2)):
        monkeypatch.setattr(markup, "label_blocks", lambda blocks, boxed, label=label: [label] * len(blocks))
        assert clean(text)[2] == left and clean(text)[0] != usual.text


@pytest.mark.parametrize(
    "text,want",
    [
        ("Før.\n\n<!-- åben\n\nLøbende tekst", "Før.\n\n åben\n\nLøbende tekst"),
        ("Før.\n\n{| class=x\n| a || b\nLøbende tekst\n\nSlut.", "Før.\n\n| a | b |\n| --- | --- |\n\nLøbende tekst\n\nSlut."),
        ("{|\n|+ Navne\n! A\n|-\n| style=\"x\" | en\nto\n|}", "Navne\n\n| A |\n| --- |\n| en to |"),
        ("En <code>a_b $x$ &lt;i&gt;</code> her.", "En `a_b $x$ <i>` her."),
        ("Se\n<pre class=\"k\">if a:\n  b = {{c}}</pre>\nslut", "Se\n\n```\nif a:\n  b = {{c}}\n```\n\nslut"),
        ("a<script>var a=1;</script>b<style>p {}</style>c", "abc"),
        ("<ol><li>en</li><li>to</li></ol>", "1. en\n2. to"),
        ("<ol start=\"4\"><li>a<ul><li>b</li></ul></li><li>c</li></ol>", None),
        ("en <code>åben", "en åben"),
    ],
)
def test_what_must_stay(text, want):
    done = read(text)
    if want is None:
        lines = done.text.split("\n")
        assert "4. a" in lines and "- b" in lines and "5. c" in lines
    else:
        assert done.text == want
    assert any(done.counts.values()) and {k for b in done.blocks for k in b.kinds} == {k for k, n in done.counts.items() if n}


def test_tags_follow_the_text():
    text = "A <b>x</b>\n\n[[B|b]]\n\n\\textbf{c}\n\nd\n\n{{q|[[w]] \\emph{e}}}"
    assert [b.kinds for b in read(text).blocks] == [["html"], ["wiki"], ["latex"], [], ["latex", "wiki"]]


def test_verbatim_elements_in_linear_time():
    for text in ("<pre>" * 40_000, "<code>x</code>" * 20_000, "<script>" * 20_000 + "</script>", "{|\n| a\n" * 20_000, "<!--" * 50_000, "<pre><code>" * 10_000 + "</code></pre>" * 10_000):
        start = time.time()
        read(text)
        assert time.time() - start < 10
