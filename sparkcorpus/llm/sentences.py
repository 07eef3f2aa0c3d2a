"""Sentence units in many languages: boundary rules compiled into a finite transducer over token classes.

A lexer cuts a text into classified tokens (words, abbreviations, initials, numbers, terminators, quotes, blank lines).
``_rule`` says what one token does in one situation; all reachable situations are enumerated once into dense tables
(next state, action). A long text is cut into chunks
between words. Each chunk is first read as a function from every situation to the one behind it (with the start of the
unit that is then open), the functions are composed by a prefix scan, and then each chunk, knowing how it is entered,
gives its units. The chunks of a very long text are read by many tasks (``queries.sentence_units``).
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import regex

# Abbreviations (without their last dot) that never end a sentence, and ones that may.
_NEVER = frozenset(
    "dr prof hr fr mr mrs ms mme mlle mgr st ste skt sr sra srta d.ª dña nr no nos núm kap kl ca c:a cirka vol vols p pp s sp pág págs pag fig figs env aprox approx abb abt bd hg hrsg art chap ch cap jf jfr jvf vgl bzw sml cf vs v z d u i e t e.g i.e bl.a u.a z.b d.h dvs dv.s o.a m.a.o ev evt incl inkl ekskl mio mill milj mrd mia co tlf afd gl sct rev gen col lt sgt capt gov sen rep pres adm maj ing lic cand mag stud f fhv "
    "ок см стр рис им ул гл пр т тов проф акад г-н д-р млн млрд тыс напр"
    "".split()
)
_MAY = frozenset("m.m m.fl m.v osv o.s.v o.l o.lign lign f.eks fx usw etc al a.m p.m kr pct st.k stk ltd inc corp jr sen e.kr f.kr fvt evt chr n.chr v.chr jh jhs sek min km г гг в вв т.е т.д т.п др пр руб коп э н.э".split())
_PARTICLES = frozenset("af av by von van de del der du da par por og och und and et y e i med mit with for für til to fra från from hos bei bij chez af".split())
_ORDINAL_LEADS = frozenset("am im vom zum beim der die das dem den des seit bis ab".split())
_AFTER_ORDINAL = frozenset("januar februar märz maerz april mai juni juli august september oktober november dezember jänner jh jhs jahrhundert jahrhunderts jahrhunderte mal".split())

#: Characters of a chunk that is read as one function; texts beyond it are chunked.
CHUNK = 2_048

# whole words of scripts that set words apart, behind which no dot, hyphen or apostrophe goes on
_WORDS = r"[A-Za-zÀ-ÖØ-öø-ʯЀ-ҁҊ-ԯؠ-ي]++(?![\p{L}\p{M}.'’·-])"
_HINDI = r"[\p{Devanagari}--[।॥]]++(?:\.[\p{Devanagari}--[।॥]]++)*+"
_LEX = regex.compile(
    rf"(?P<RUN>{_WORDS}(?:,?[ ](?:{_WORDS}|\d++(?![\p{{L}}\p{{M}}.:]|,\d)))*+)"
    r"|(?P<FQ>[   ][»](?=[\s.,;:!?)]|$))|(?m:(?P<HEAD>^[ \t]{0,3}\#{1,6}[ \t][^\n]*))|(?P<SPC>[^\S\n]+(?:\n(?![^\S\n]*\n)[^\S\n]*)?)|(?P<DOT>\.(?!\.)|۔)|(?P<NUM>\d+(?:[.,:]\d+)*)|(?P<BLANK>\n[^\S\n]*\n\s*)|(?P<NL>\n[^\S\n]*)"
    r"|(?P<CONT>[,;:،؛，、；：])|(?P<FULL>[。！？｡][。！？｡!?]*)|(?P<QT>(?<=[」』”])(?:と|って))|(?P<CJR>(?<=[”』」])[\p{Han}]+)|(?P<CJ>[\p{Han}\p{Hiragana}\p{Katakana}ー々]+)|(?P<TH>[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+)"
    rf"|(?P<HI>{_HINDI}(?:[ ]{_HINDI})*+)"
    r"|(?P<WORD>[\p{L}\p{M}]+(?:[.'’·-][\p{L}\p{M}\d]+)*)|(?P<ELL>…+|\.{2,})|(?P<DANDA>[।॥]+)|(?P<BANG>[!?؟‼⁇⁈⁉]+)"
    r"|(?P<LDQ>“)|(?P<QUOTE>[»«”\"'’‘)\]」』）】〉》›‹}])|(?P<OPEN>[„‚¿¡(\[「『（【〈《{])|(?P<DASH>[—–―-]+)|(?P<OTHER>.)",
    regex.S | regex.V1,
)
_IDEOGRAPHS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+")
# Verbs of speech with which a Chinese reporting clause ends, and what ends a sentence.
_SAID = regex.compile(r"(?=[说說道喊问問答叫写寫](?:\n?道)?[。，！？])")
_STOP = regex.compile(r"[。！？]")
_WORD_CLASSES = ("LOW", "PART", "ORDP", "UP", "MONTH", "INIT", "ABN", "ABNU", "ABM", "CL", "CLA")
CLASSES = ("BLANK", "HEAD", "FQ", "SPC", "NL", "ELL", "FULL", "DANDA", "BANG", "DOT", "LDQ", "QUOTE", "OPEN", "CONT", "DASH", "NUM2", "NUM4", "QT", "CJR", "CJ", "TH", "HI", "OTHER", *_WORD_CLASSES)
_CODE = {c: i for i, c in enumerate(CLASSES)}
#: Class of what each group of the lexer finds; -1 where the text itself decides.
_KINDS = [-1] * (_LEX.groups + 1)
for _name, _place in _LEX.groupindex.items():
    if _name in _CODE and _name not in ("CJR", "OTHER"):
        _KINDS[_place] = _CODE[_name]
#: What a token does: nothing; its end is a possible unit end; the same for the token before it; the possible end is one; the unit ends before the token; the token is a unit.
NONE, MARK, MARK_BEFORE, CONFIRM, BREAK, ALONE = range(6)
#: No unit is open; the value is that from before the chunk.
NOT_OPEN, CARRIED = -1, -2
_SKIPPED = frozenset((_CODE["SPC"], _CODE["NL"], _CODE["BLANK"]))


def _word_class(word: str, dotted: bool) -> str:
    low = word.lower()
    first = word[0]
    if first.lower() == first.upper():
        return "CLA" if len(word) == 1 and dotted else "CL"
    if dotted:
        if len(word) == 1 and first.isupper():
            return "INIT"
        if low in _NEVER:
            return "ABNU" if first.isupper() else "ABN"
        if low in _MAY or ("." in word and len(word) <= 6):
            return "ABM"
    if low in _AFTER_ORDINAL and first.isupper():
        return "MONTH"
    if low in _ORDINAL_LEADS:
        return "ORDP"
    if first.isupper():
        return "UP"
    return "PART" if low in _PARTICLES else "LOW"


class _Reports:
    """Whether a reporting clause follows a place: a verb of speech before the sentence's end. Read once for each text."""

    def __init__(self, text: str, beyond: bool = False):
        self.said = [m.start() for m in _SAID.finditer(text)]
        self.stops = [m.start() for m in _STOP.finditer(text)]
        self.beyond = beyond

    def follows(self, at: int) -> bool:
        """``beyond`` answers where the text ends before either comes."""
        said, stop = bisect_left(self.said, at), bisect_left(self.stops, at)
        if said < len(self.said):
            return stop == len(self.stops) or self.said[said] < self.stops[stop]
        return stop == len(self.stops) and self.beyond


_classes: dict[str, int] = {}


def _class_of(word: str) -> int:
    """Class of a word or number without a dot behind it; the last ones are remembered."""
    code = _classes.get(word)
    if code is None:
        if len(_classes) > 200_000:
            _classes.clear()
        name = _word_class(word, False) if word[0].isalpha() else "NUM2" if len(word) <= 2 else "NUM4"
        code = _classes[word] = _CODE[name]
    return code


def tokens(text: str, beyond: bool = False) -> list[tuple[int, int, int]]:
    """(class, start, end) of the tokens of a text or of a piece of one (see ``chunk_ends``).

    A run of words and numbers gives its first and its last one only: what stands between changes nothing. ``beyond``: whether a
    reporting clause that begins in a piece goes on to a verb of speech behind it.
    """
    out, at, reports = [], 0, None
    while at is not None:
        begin, at = at, None
        for m in _LEX.finditer(text, begin):
            start, end = m.span()
            kind = _KINDS[m.lastindex]
            if kind >= 0:
                out.append((kind, start, end))
                continue
            name = m.lastgroup
            if name == "RUN":
                run = m.group()
                space = run.find(" ")
                if space < 0:
                    out.append((_classes.get(run) or _class_of(run), start, end))
                    continue
                first = run[: space - 1] if run[space - 1] == "," else run[:space]
                last = run[run.rfind(" ") + 1 :]
                out.append((_classes.get(first) or _class_of(first), start, start + len(first)))
                out.append((_classes.get(last) or _class_of(last), end - len(last), end))
                continue
            if name == "WORD":
                name = _word_class(m.group(), text[end : end + 1] == ".")
            elif name == "NUM":
                name = "NUM2" if end - start <= 2 else "NUM4"
            elif name == "OTHER":
                name = "SPC" if m.group().isspace() else name
            elif name == "CJR":
                reports = reports or _Reports(text, beyond)
                if not reports.follows(start):
                    name, whole = "CJ", _IDEOGRAPHS.match(text, start).end()
                    if whole > end:
                        # kana go on what was no clause: the text is read on from behind them
                        out.append((_CODE[name], start, whole))
                        at = whole
                        break
            out.append((_CODE[name], start, end))
    return out


_LOWER = {"LOW", "PART", "ABN", "ABM"}
_UPPER = {"UP", "MONTH", "INIT", "ABNU", "ORDP_UP"}
_TERMS = {"DOT": "strong", "BANG": "bang", "ELL": "ell", "FULL": "full", "DANDA": "full"}
_CONTEXT = {"LOW": "low", "PART": "part", "ORDP": "ordp", "UP": "word", "MONTH": "word", "ABN": "abn", "ABNU": "abn", "CLA": "abn", "ABM": "abm", "CL": "cl", "CJ": "cj", "CJR": "cj", "QT": "cj", "HI": "hi", "NUM4": "num"}
_START = ("start", "", False, False, False, False)


def _rule(state: tuple, c: str) -> tuple[tuple, int]:
    """What token class ``c`` does in a situation.

    context: what kind of token came last; pending: why a unit may have ended; spaced: whether white space followed that
    end; closed: whether closing marks did; opened: whether an opening mark of the next unit did; quoted: whether the
    unit began with a quotation.
    """
    context, pending, spaced, closed, opened, quoted = state
    if c == "BLANK":
        return _START, BREAK
    if c == "HEAD":
        return _START, ALONE
    if pending:
        go_on = lambda: _plain((context, "", False, False, False, quoted), c)
        fresh_unit = lambda: (_plain(("start", "", False, False, False, opened), c)[0], CONFIRM)
        if pending == "thai":
            return (state, NONE) if c in ("SPC", "NL") else fresh_unit()
        if c in ("SPC", "NL"):
            return (context, pending, True, closed, opened, quoted), NONE
        if not spaced:
            if c in ("QUOTE", "FQ") or (c == "LDQ" and pending != "full"):
                return (context, pending, False, True, False, quoted), MARK
            if c in _TERMS:
                new = _TERMS[c] if c != "DOT" else pending
                return (context, new if pending not in ("full",) else "full", False, closed, False, quoted), MARK
            if c == "CONT" or c == "DASH" or c == "QT" or (c == "CJR" and closed and quoted):
                return go_on()
            if pending == "full" or (pending == "bang" and c in ("CJ", "CJR", "TH", "HI", "CL", "CLA")):
                return fresh_unit()
            return go_on()
        if c in ("QUOTE", "OPEN", "LDQ", "FQ"):
            return (context, pending, True, closed, True, quoted), NONE
        if c == "CONT" or (c == "DASH" and (closed or pending in ("ell", "never"))):
            return go_on()
        if c == "DASH":
            return (context, pending, True, closed, opened, quoted), NONE
        if pending == "full":
            return fresh_unit()
        if c in _TERMS:
            return (context, "ell", False, closed, False, quoted), MARK
        if pending == "never":
            return go_on()
        if c in _LOWER:
            return go_on()
        if c == "HI" and context == "hi" and pending in ("strong", "may", "num", "ord"):
            # a dot behind a Hindi word abbreviates; one behind another script ends its sentence
            return go_on()
        if pending == "ord" and c not in ("NUM2", "NUM4"):
            return go_on()
        if pending == "num" and c == "MONTH":
            return go_on()
        if pending == "letter" and c == "INIT":
            return go_on()
        return fresh_unit()
    if c in _TERMS:
        kind = _TERMS[c]
        if c == "DOT":
            kind = {"abn": "never", "name": "never", "abm": "may", "letter": "letter", "num2": "num", "num": "num", "ord": "ord"}.get(context, "strong")
        return (context, kind, False, False, False, quoted), MARK
    return _plain(state, c)


def _plain(state: tuple, c: str) -> tuple[tuple, int]:
    """A token that ends nothing."""
    context, _, _, _, _, quoted = state
    if c in ("SPC", "NL"):
        if context == "th" and c == "SPC":
            return ("th", "thai", True, False, False, quoted), MARK_BEFORE
        return (context, "", False, False, False, quoted), NONE
    if context == "start" and c in ("QUOTE", "LDQ", "OPEN"):
        return ("punct", "", False, False, False, True), NONE
    if c == "TH":
        new = "th"
    elif c in ("NUM2", "NUM4") and context == "th":
        new = "th"
    elif c == "INIT":
        new = "letter" if context == "low" else "name"
    elif c == "NUM2":
        new = "ord" if context == "ordp" else "num2"
    else:
        new = _CONTEXT.get(c, "punct")
    return (new, "", False, False, False, quoted), NONE


class Transducer:
    """The rules as tables over all situations that can be reached."""

    def __init__(self):
        states, at = {_START: 0}, 0
        order, nxt, act = [_START], [], []
        while at < len(order):
            row, what = [], []
            for c in CLASSES:
                new, action = _rule(order[at], c)
                if new not in states:
                    states[new] = len(order)
                    order.append(new)
                row.append(states[new])
                what.append(action)
            nxt.append(row)
            act.append(what)
            at += 1
        self.next, self.action = nxt, act
        self.table, self.acts = np.array(nxt, np.int64).T.copy(), np.array(act, np.int8).T.copy()
        #: Situations in which no unit end is pending: a chunk begins and ends in one of them.
        self.entries = np.array([i for i, s in enumerate(order) if not s[1]])
        #: Those in which no unit is open.
        self.closed = np.array([order[i][0] == "start" for i in self.entries])
        self.entry = np.full(len(order), -1)
        self.entry[self.entries] = np.arange(len(self.entries))

    def function(self, found: list[tuple[int, int, int]], offset: int = 0) -> np.ndarray:
        """A chunk as a function of the situation it is entered in: a row for each entry with the exit, the start of the
        unit that is open behind the chunk (``NOT_OPEN`` without one) and the end of the last token (``CARRIED``: as before the chunk)."""
        n = len(self.entries)
        state = self.entries.copy()
        begin, last = np.where(self.closed, NOT_OPEN, CARRIED), np.full(n, CARRIED)
        mark, after = np.full(n, -1), np.full(n, -1)
        for k, (c, lo, hi) in enumerate(found):
            if k and (state == state[0]).all() and (begin == begin[0]).all() and (mark == mark[0]).all() and (after == after[0]).all() and (last == last[0]).all():
                # all situations have met, so the rest is read from one
                _, b, e, s = self.run(found[k:], int(state[0]), int(begin[0]), int(last[0]), (int(mark[0]), int(after[0])))
                state[:], begin[:], last[:] = s, b, e
                break
            action, state = self.acts[c][state], self.table[c][state]
            marks = action == MARK
            mark, after = np.where(marks, hi, mark), np.where(marks, -1, after)
            marks = action == MARK_BEFORE
            mark, after = np.where(marks, last, mark), np.where(marks, -1, after)
            confirmed = action == CONFIRM
            begin = np.where(confirmed, np.where(after >= 0, after, lo), begin)
            ended = (action == BREAK) | (action == ALONE)
            begin = np.where(ended, NOT_OPEN, begin)
            mark = np.where(confirmed | ended, -1, mark)
            last = np.where(action == ALONE, hi, last)
            if c not in _SKIPPED:
                other = action != ALONE
                begin = np.where(other & (begin == NOT_OPEN), lo, begin)
                after = np.where(other & (mark >= 0) & (after < 0) & (lo >= mark), lo, after)
                last = np.where(other, hi, last)
        out = np.stack([self.entry[state], begin, last], axis=1)
        out[:, 1:] += np.where(out[:, 1:] >= 0, offset, 0)
        return out

    def run(self, found: list[tuple[int, int, int]], state: int, begin: int = NOT_OPEN, last: int = NOT_OPEN, pending: tuple[int, int] = (-1, -1)) -> tuple[list[tuple[int, int]], int, int, int]:
        """Units that end in a chunk read from ``state``, the start of the unit still open (``begin``: that of the unit
        open before, ``last`` the end of the token before), the end of the last token and the state behind the chunk.
        ``pending``: the possible unit end, and the start of what follows it, that were read before."""
        out = []
        mark, after = pending
        nxt, act = self.next, self.action
        for c, lo, hi in found:
            action = act[state][c]
            state = nxt[state][c]
            if action:
                if action == MARK:
                    mark, after = hi, -1
                elif action == MARK_BEFORE:
                    mark, after = last, -1
                elif action == CONFIRM:
                    if begin != NOT_OPEN:
                        out.append((begin, mark))
                    begin, mark = after if after >= 0 else lo, -1
                else:
                    if begin != NOT_OPEN:
                        out.append((begin, last))
                    begin, mark = NOT_OPEN, -1
                    if action == ALONE:
                        out.append((lo, hi))
                        last = hi
                        continue
            if c not in _SKIPPED:
                if begin == NOT_OPEN:
                    begin = lo
                if mark >= 0 and after < 0 and lo >= mark:
                    after = lo
                last = hi
        return out, begin, last, state


TRANSDUCER = Transducer()
_HEAD = regex.compile(r"[ \t]{0,3}#{1,6}[ \t]")
_CUT = regex.compile(r"\n[^\S\n]*\n\s*(?=\S)|(?<=[\p{Ll}])[^\S\n](?=\p{Ll}{2})|(?<=[\p{Han}\p{Hiragana}])(?=[\p{Han}\p{Hiragana}])")


def chunk_ends(text: str, size: int = CHUNK) -> list[int]:
    """Ends of chunks of about ``size``: behind a blank line, or between two lower-case words or two ideographs, where
    no unit end is pending. A stretch without such a place stays whole, and so does a heading line."""
    out, at, line = [], 0, 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m or m.end() >= len(text):
            break
        if not m.group().startswith("\n"):
            line = max(line, text.rfind("\n", line, m.start()) + 1)
            if _HEAD.match(text, line):
                close = text.find("\n", m.start())
                m = _CUT.search(text, close) if close >= 0 else None
                if not m or m.end() >= len(text):
                    break
        at = m.end()
        out.append(at)
    return [*out, len(text)]


def pieces(text: str, size: int = CHUNK) -> list[tuple[int, str, bool]]:
    """(offset, piece, whether a reporting clause open at its end goes on to a verb of speech) of a text's chunks."""
    ends = chunk_ends(text, size)
    if len(ends) == 1:
        return [(0, text, False)]
    reports = _Reports(text)
    return [(lo, text[lo:hi], reports.follows(hi)) for lo, hi in zip([0, *ends], ends)]


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """One chunk's function after another's (along leading axes, many at once)."""
    out = np.take_along_axis(then, first[..., :1], axis=-2)
    out[..., 1:] = np.where(out[..., 1:] == CARRIED, first[..., 1:], out[..., 1:])
    return out


def entered(functions: np.ndarray) -> np.ndarray:
    """(situation, open unit, last end) in which each of a text's chunks is entered, from the chunks' functions.

    A prefix scan by doubling steps: step s composes every function with the one 2^s before it, all at once.
    """
    total, step = functions.copy(), 1
    while step < len(total):
        total[step:] = composed(total[:-step], total[step:])
        step *= 2
    start = int(TRANSDUCER.entry[0])
    out = np.full((len(total), 3), NOT_OPEN)
    out[0, 0] = start
    out[1:] = total[:-1, start]
    out[:, 1:] = np.where(out[:, 1:] == CARRIED, NOT_OPEN, out[:, 1:])
    return out


def piece_units(found: list[tuple[int, int, int]], offset: int, piece: str, at: tuple[int, int, int], final: bool) -> list[tuple[int, int]]:
    """Units that end in a chunk entered in situation ``at``, as offsets into the whole text, without surrounding white space."""
    state, begin, last = at
    if offset:
        found = [(c, lo + offset, hi + offset) for c, lo, hi in found]
    units, begin, last, _ = TRANSDUCER.run(found, int(TRANSDUCER.entries[state]), begin, last)
    if final and begin != NOT_OPEN and last > begin:
        units.append((begin, last))
    out = []
    for lo, hi in units:
        # only a heading's token holds white space at its ends, and it lies in one chunk
        while offset <= lo < hi and piece[lo - offset].isspace():
            lo += 1
        while hi > max(lo, offset) and piece[hi - offset - 1].isspace():
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def sentences(text: str | None, size: int = CHUNK) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, without surrounding white space; a null or blank text has none."""
    if not text:
        return []
    parts = pieces(text, size)
    found = [tokens(piece, beyond) for _, piece, beyond in parts]
    if len(parts) == 1:
        at = np.array([[TRANSDUCER.entry[0], NOT_OPEN, NOT_OPEN]])
    else:
        at = entered(np.stack([TRANSDUCER.function(f, lo) for f, (lo, _, _) in zip(found, parts)]))
    return [u for k, (f, (lo, piece, _)) in enumerate(zip(found, parts)) for u in piece_units(f, lo, piece, tuple(at[k].tolist()), k + 1 == len(parts))]
