"""Language by compression: the language whose dictionary makes a text smallest, rejected when the margin is narrow.

Each language has a raw-content zstandard dictionary filled with sentences of a bounded sample of labelled rows. Labels
are noisy, so a dictionary takes only sentences whose letter triples are most frequent under their own label. A text is
cut into sentence units; each unit goes to the language with the smallest output, units with a narrow margin to the
language of their surroundings, and the text's main language is the one with most characters.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcorpus.llm.sentences import sentences

# The languages, with the codes and names that a label may use.
NAMES = {
    "da": "da dan danish dansk dänisch danois danés", "sv": "sv swe swedish svenska svensk schwedisch suédois sueco", "nb": "nb nob no nor nn nno norwegian norsk bokmål bokmal nynorsk norwegisch norvégien noruego",
    "en": "en eng english engelsk englisch anglais inglés", "de": "de deu ger german deutsch tysk allemand alemán", "fr": "fr fra fre french français francais fransk französisch francés", "es": "es spa spanish español espanol castellano spansk spanisch espagnol",
    "ru": "ru rus russian русский russisk russisch russe ruso", "zh": "zh zho chi cmn chinese 中文 汉语 漢語 kinesisk chinesisch chinois chino", "ja": "ja jpn japanese 日本語 japansk japanisch japonais japonés",
    "th": "th tha thai ไทย ภาษาไทย thailandsk thailändisch thaï", "hi": "hi hin hindi हिन्दी हिंदी", "ar": "ar ara arabic العربية عربي arabisk arabisch arabe árabe",
}
#: Labels of languages that no text here has; they name a language all the same.
_OTHERS = frozenset("it ita italian italiano pt por portuguese nl nld dutch fi fin finnish is isl icelandic fo fao faroese pl pol polish cs ces czech tr tur turkish ko kor korean la lat latin el ell greek he heb hebrew uk ukr ukrainian hu hun hungarian ro ron romanian bg bul bulgarian vi vie vietnamese id ind kl kal sk slk sl slv hr hrv sr srp et est lv lav lt lit fa fas ur urd bn ben ta tam".split())
_CODES = {name: code for code, names in NAMES.items() for name in names.split()}
#: A sentence or two of each language, so that one without labelled rows still has a dictionary.
_SEEDS = {
    "da": "Det er ikke muligt at sige, hvornår byen blev grundlagt, men der findes mange gamle kilder om den, og de fleste af dem er skrevet på dansk.", "sv": "Det är inte möjligt att säga när staden grundades, men det finns många gamla källor om den, och de flesta av dem är skrivna på svenska.",
    "nb": "Det er ikke mulig å si når byen ble grunnlagt, men det finnes mange gamle kilder om den, og de fleste av dem er skrevet på norsk.", "en": "It is not possible to say when the town was founded, but there are many old sources about it, and most of them were written in English.",
    "de": "Es ist nicht möglich zu sagen, wann die Stadt gegründet wurde, aber es gibt viele alte Quellen darüber, und die meisten sind auf Deutsch geschrieben.", "fr": "Il n'est pas possible de dire quand la ville a été fondée, mais il existe de nombreuses sources anciennes, et la plupart sont écrites en français.",
    "es": "No es posible decir cuándo se fundó la ciudad, pero existen muchas fuentes antiguas sobre ella, y la mayoría están escritas en español.", "ru": "Невозможно сказать, когда был основан город, но о нём есть много старых источников, и большинство из них написано на русском языке.",
    "zh": "无法确定这座城市是什么时候建立的，但是关于它有许多古老的资料，其中大多数是用中文写的。", "ja": "この町がいつ作られたのかは分からないが、多くの古い史料があり、そのほとんどは日本語で書かれている。",
    "th": "ไม่สามารถบอกได้ว่าเมืองนี้ก่อตั้งเมื่อใด แต่มีเอกสารเก่าจำนวนมาก และส่วนใหญ่เขียนเป็นภาษาไทย", "hi": "यह कहना संभव नहीं है कि शहर की स्थापना कब हुई थी, लेकिन इसके बारे में कई पुराने स्रोत हैं, और उनमें से अधिकांश हिंदी में लिखे गए हैं।",
    "ar": "لا يمكن القول متى تأسست المدينة، ولكن هناك العديد من المصادر القديمة عنها، ومعظمها مكتوب باللغة العربية.",
}
#: Bounds of the fit for each language: labelled rows sampled, their sentences looked at in the first round, bytes kept.
TRAIN_ROWS, TRAIN_SENTENCES, DICTIONARY = 500, 2_000, 80_000
#: Units of a sampled text that the fit looks at, spread over the text, and the characters of one.
TEXT_UNITS, UNIT_CHARS = 100, 2_000
#: A unit is decided only if the best output is smaller than the next by this share and this many bytes.
MARGIN, MARGIN_BYTES = 0.2, 3
#: A text without any decided unit has no language if the margin of the whole is narrower than this.
REJECTED = 0.05
#: Units whose answer a worker remembers; the memory is emptied when full.
REMEMBERED = 100_000
#: A sampled sentence fills a dictionary if its own label is likelier than any other by this (natural logarithm).
CLEAR = 3.0
#: Texts of each label that the second fit looks at, and the confidence with which the first may speak against a unit of theirs.
SECOND_TEXTS, AGAINST = 300, 0.35
LEVEL = 4
#: A sentence is novel to a dictionary if its output is larger than this share of it.
NOVEL = 0.33


def label_language(label: str | None) -> str | None:
    """The language code a label names, "other" for a language not among these, None where it names none."""
    if label is None:
        return None
    text = label.strip().lower().replace("_", "-")
    for part in (text, text.split("-")[0], text.split(" ")[0], text.split("(")[0].strip()):
        if part in _CODES:
            return _CODES[part]
        if part in _OTHERS:
            return "other"
    return None


def label_code(label: Column) -> Column:
    """``label_language`` as an expression; null where a label names none of the languages here."""
    text = F.lower(F.replace(F.trim(label), F.lit("_"), F.lit("-")))
    known = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.coalesce(*[F.try_element_at(known, part) for part in (text, F.split_part(text, F.lit("-"), F.lit(1)), F.split_part(text, F.lit(" "), F.lit(1)), F.trim(F.split_part(text, F.lit("("), F.lit(1))))])


_scripts: dict[str, str | None] = {}


def _script_of(ch: str) -> str | None:
    """Script of a letter by the first word of its Unicode name, None for what is no letter; letters met are remembered."""
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "?").split(" ")[0]
    return "LATIN" if name in ("FEMININE", "MASCULINE", "MODIFIER", "MATHEMATICAL", "FULLWIDTH") else "HIRAGANA" if name == "KATAKANA" or name.startswith("KATAKANA-HIRAGANA") else name


def _script(text: str) -> frozenset[str]:
    """Scripts of a text's letters."""
    found = set()
    for ch in set(text):
        if ch not in _scripts:
            _scripts[ch] = _script_of(ch)
        found.add(_scripts[ch])
    return frozenset(found - {None})


#: Letters of these scripts say about as much as two of another.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff]+")
_RUNS = re.compile(r"[^\W\d_]+")
_EIGHT = re.compile(r"(?:[\W\d_]*+[^\W\d_]){8}")


def _letters(text: str) -> int:
    """Letters, those of dense scripts twice."""
    n = sum(map(len, _RUNS.findall(text)))
    return n if text.isascii() else n + sum(c.isalpha() for run in _DENSE.findall(text) for c in run)


def _few(text: str) -> bool:
    """Whether there are fewer than eight letters, those of dense scripts counted twice."""
    return not _EIGHT.match(text) and _letters(text) < 8


def _latin_leads(text: str) -> bool:
    """Whether more letters are Latin than not."""
    latin = sum("LATIN" in _script(c) for c in text)
    return 2 * latin > _letters(text)


_NAME = re.compile(r"[ \n][^\W\d_a-zæøåäöüéèñßа-я][^\W\d_]{3,}")
_DIGITS = re.compile(r"\d+")
_ODD = re.compile(r"[^\w\s.,]|\d")


def _name(m: re.Match) -> str:
    """X for a capitalised word inside the sentence."""
    word, at = m.group(), m.start()
    return f"{word[0]}X" if at and word[1].isupper() and not m.string[at - 1].isspace() else word


def _masked(text: str) -> str:
    """Without what tells nothing about the language: numbers, and capitalised words inside the sentence (mostly names)."""
    return _DIGITS.sub("0", _NAME.sub(_name, text))


class CompressionClassifier:
    """``sizes(text)`` under each language's dictionary; picklable as the dictionaries' bytes."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries
        self._ready: dict | None = None

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.dictionaries, self._ready = state, None

    def _load(self) -> dict:
        if self._ready is None:
            self._ready, self.scripts, self.known = {}, {}, {}
            for code, content in self.dictionaries.items():
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                words.precompute_compress(compression_params=parameters)
                self._ready[code] = zstandard.ZstdCompressor(dict_data=words, compression_params=parameters)
                self.scripts[code] = _script(_SEEDS.get(code, content.decode("utf-8", "ignore")[:2000]))
            self.by_script: dict[tuple[frozenset, bool], list[str]] = {}
            # a word's languages as a number with a digit for each, so that the numbers of a text's words add up
            self.vocabulary: dict[str, int] = {}
            self.digit = {code: 16 * k for k, code in enumerate(self.dictionaries)}
            for code, content in self.dictionaries.items():
                for word in set(_RUNS.findall(content.decode("utf-8", "ignore"))):
                    self.vocabulary[word] = self.vocabulary.get(word, 0) + (1 << self.digit[code])
        return self._ready

    def candidates(self, text: str) -> list[str]:
        """Languages that share a script with the text's letters; all where none does.

        A script beside Latin decides against it, unless most letters are Latin: then both are candidates."""
        ready = self._load()
        scripts = _script(text)
        both = len(scripts) > 1 and "LATIN" in scripts and _latin_leads(text)
        known = self.by_script.get((scripts, both))
        if known is None:
            # a script of its own decides against the Latin of names and units beside it
            own = scripts - {"LATIN"} or scripts
            if "HIRAGANA" in own:
                own = frozenset({"HIRAGANA"})
            if both:
                own |= {"LATIN"}
            known = [c for c in ready if self.scripts[c] & own] or list(ready)
            self.by_script[scripts, both] = known
        return known

    def sizes(self, masked: str) -> dict[str, int]:
        """Output sizes under the dictionaries that can come first or second.

        A dictionary makes a text small by what it has of it. Where words are set apart, dictionaries that hold less than
        half as many of a text's words as the second best of them are left out before anything is compressed.
        """
        ready, raw, able = self._load(), masked.encode("utf-8", "replace"), self.candidates(masked)
        if len(able) > 2:
            known = self.vocabulary.get
            total = sum([known(word, 0) for word in _RUNS.findall(masked)[:65_000]])
            held = [total >> self.digit[c] & 0xFFFF for c in able]
            enough = sorted(held)[-2] / 2
            able = [c for c, n in zip(able, held) if n >= enough]
        return {c: len(ready[c].compress(raw)) for c in able}

    def classify(self, text: str) -> tuple[str, float, bool]:
        """Best language, confidence (share by which the next best is larger), and whether the margin is wide enough.

        Units that are equal but for what is masked come out alike, so a worker remembers the last ones.
        """
        masked = _masked(text)
        known = self.known.get(masked) if self._ready else None
        if known is None:
            found = sorted((n, c) for c, n in self.sizes(masked).items())
            if len(found) == 1:
                known = found[0][1], 1.0, True
            else:
                (best, code), (second, _) = found[:2]
                confidence = (second - best) / max(second, 1)
                known = code, round(confidence, 4), confidence >= MARGIN and second - best >= MARGIN_BYTES
            if len(masked) < 500:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[masked] = known
        return known


def _filled(pools: dict[str, list[str]], rng: random.Random) -> dict[str, bytes]:
    """Dictionaries from sentences, the most novel first kept: a sentence that the dictionary so far already makes small adds nothing."""
    out = {}
    for code in NAMES:
        pool = sorted({_masked(s) for s in pools.get(code, [])})
        rng.shuffle(pool)
        kept, size, tester = [_SEEDS[code]], len(_SEEDS[code].encode()), None
        for k, s in enumerate(pool):
            if size >= DICTIONARY:
                break
            if k % 25 == 0:
                words = zstandard.ZstdCompressionDict("\n".join(kept).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                tester = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False)
            raw = s.encode("utf-8", "replace")
            if k < 40 or len(tester.compress(raw)) > NOVEL * len(raw):
                kept.append(s)
                size += len(raw) + 1
        # zstandard finds the end of a dictionary cheapest, so the seed stands first
        out[code] = "\n".join(kept).encode("utf-8", "replace")
    return out


def _units(text: str) -> list[str]:
    return [u for lo, hi in sentences(text) if not (u := text[lo:hi]).startswith("#") and _EIGHT.match(u)]


def _agreeing(pools: dict[str, list[str]], clear: float = CLEAR) -> dict[str, list[str]]:
    """Sentences whose letter triples are more at home under the label they came with than under any other.

    A wrong label puts a sentence among many right ones, where its triples are rare, so a share of wrong labels well
    below half does no harm.
    """
    codes = list(pools)
    at: defaultdict[str, int] = defaultdict()
    at.default_factory = at.__len__

    def triples(text: str) -> np.ndarray:
        """Numbers of the triples in what lies between odd characters."""
        return np.array([at[t] for t in {run[i : i + 3] for run in _ODD.split(text) for i in range(len(run) - 2)}], np.int64)

    found = {c: [(x, triples(_masked(x).lower())) for x in pools[c]] for c in codes}
    seeds = {c: triples(_SEEDS[c].lower()) for c in codes}
    counts = np.zeros((len(at), len(codes)))
    for k, c in enumerate(codes):
        np.add.at(counts[:, k], np.concatenate([seeds[c], *[i for _, i in found[c]]]), 1)
    sizes = np.array([len(pools[c]) for c in codes]) + 2.0
    score, without = np.log((counts + 0.2) / sizes), np.log((np.maximum(counts - 1, 0) + 0.2) / sizes)
    out = {}
    for k, c in enumerate(codes):
        kept = set()
        for x, own in found[c]:
            total = score[own].sum(axis=0)
            # a sentence doesn't speak for itself: under its own label it is left out of the counts
            mine, total[k] = without[own, k].sum(), -np.inf
            if mine > total.max() + clear:
                kept.add(x)
        out[c] = sorted(kept)
    return out


def units_of(text: str | None) -> list[str]:
    """The sentence units of a text that the fit looks at: no headings, at least eight letters, within the bounds."""
    units = [u for u in _units(text) if len(u) <= UNIT_CHARS] if text else []
    return units[:: -(-len(units) // TEXT_UNITS) or 1]


def fit(rows: Iterable[tuple[str | None, list[str]]], seed: int = 11) -> CompressionClassifier:
    """From labels and the units of their texts, in two rounds.

    The first dictionaries hold the sentences whose letter triples are likeliest under their own label. The second are
    filled from texts whose label agrees with what the first say about most of their letters, without units that the
    first clearly give to another language; so neither wrong labels nor quoted languages get in, and rare phrases stay.
    """
    rng = random.Random(seed)
    texts: dict[str, list[list[str]]] = {code: [] for code in NAMES}
    for label, units in rows:
        code = label_language(label)
        if code in NAMES and units:
            texts[code].append(units)
    for own in texts.values():
        rng.shuffle(own)
    # repeats stay: how often a sentence comes under each label is what tells a wrong label
    first = CompressionClassifier(_filled(_agreeing({c: [u for units in own for u in units][:TRAIN_SENTENCES] for c, own in texts.items()}), rng))
    pools: dict[str, list[str]] = {}
    for code, own in texts.items():
        for units in own[:SECOND_TEXTS]:
            said = [first.classify(u) for u in units]
            length: dict[str, int] = {}
            for u, (found, _, _) in zip(units, said):
                length[found] = length.get(found, 0) + len(u)
            if max(length, key=length.get) == code:
                pools.setdefault(code, []).extend(u for u, (found, confidence, _) in zip(units, said) if found == code or confidence < AGAINST)
    # a quoted language that the first dictionaries did not know well enough shows in its letter triples
    return CompressionClassifier(_filled(_agreeing({c: pools.get(c, []) for c in NAMES}, 0.0), rng))


def segments(model: CompressionClassifier, text: str) -> list[tuple[int, int, str | None, float]]:
    """(start, end, language, confidence) of maximal stretches of sentence units in one language.

    Heading lines, units with few letters and units with a narrow margin join the stretch they stand in: the language
    before them, or after them at the start, if that has their script. A text of nothing else is classified as a whole,
    and rejected (language None) if that is narrow too.
    """
    units = sentences(text)
    if not any(c.isalpha() for c in text):
        return []
    found: list[tuple[int, int, str | None, float]] = []
    unsure: dict[int, tuple[str, list[str]]] = {}
    for lo, hi in units:
        unit = text[lo:hi]
        if unit[0] == "#" or _few(unit):
            found.append((lo, hi, None, 0.0))
            continue
        code, confidence, sure = model.classify(unit)
        if not sure:
            able, scripts = model.candidates(_masked(unit)), _script(unit)
            # where nothing around can decide, a language whose scripts all occur goes before one that lacks some (no kana: not Japanese)
            unsure[lo] = min(able, key=lambda c: (not model.scripts[c] <= scripts, c != code)), able
        found.append((lo, hi, code if sure else None, confidence))
    if all(f[2] is None for f in found):
        whole = "\n".join(text[lo:hi] for lo, hi, _, _ in found if not text[lo:hi].startswith("#")) or text
        code, confidence, _ = model.classify(whole)
        return [(units[0][0], units[-1][1], code if confidence >= REJECTED else None, confidence)]
    first = next(f[2] for f in found if f[2])
    out: list[list] = []
    for lo, hi, code, confidence in found:
        if code is None:
            code = out[-1][2] if out else first
            best, able = unsure.get(lo, (code, [code]))
            code = code if code in able else best
        if out and out[-1][2] == code:
            weight = hi - lo
            out[-1][3] = (out[-1][3] * out[-1][4] + confidence * weight) / (out[-1][4] + weight)
            out[-1][1], out[-1][4] = hi, out[-1][4] + weight
        else:
            out.append([lo, hi, code, confidence, hi - lo])
    return [(lo, hi, code, round(c, 4)) for lo, hi, code, c, _ in out]


def judge(model: CompressionClassifier, text: str | None, label: str | None) -> tuple[str | None, float, list[str], list[tuple[int, int, str | None, float]]]:
    """Main language and confidence, cases (missing, wrong, mixed), and the segments. Texts without letters have none;
    a rejected text has a confidence and a segment but no language and no case."""
    parts = segments(model, text) if text else []
    if not parts:
        return None, 0.0, [], []
    if parts[0][2] is None:
        return None, parts[0][3], [], parts
    length: dict[str, int] = {}
    for lo, hi, code, _ in parts:
        length[code] = length.get(code, 0) + hi - lo
    main = max(sorted(length), key=lambda c: length[c])
    confidence = sum(c * (hi - lo) for lo, hi, code, c in parts if code == main) / length[main]
    named = label_language(label)
    cases = ["missing"] if named is None else ["wrong"] if named != main else []
    return main, round(confidence, 4), cases + (["mixed"] if len(length) > 1 else []), parts
