"""Left-over HTML, MediaWiki and LaTeX markup in Markdown: find it, convert it, and judge the blocks it leaves.

A text is read once into spans (code, formulas, residue, plain). Code spans and blocks stay as they are; residue is
counted by kind and rewritten as Markdown. The rewritten text is then cut into blocks and classified in two passes:
length, link density and stop-word density decide clear blocks, and short or ambiguous ones take the label of the
nearest decided neighbours. Marks are paired from precomputed positions or by a stack of open ones, so that a text takes
linear time however long or deep they are. Blocks that end up as residue and came only from markup containers (HTML elements that
group things, wiki tables, templates) are left out; headings, code, formulas, lists and tables that are not mostly links
stay wherever they stand.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from html.entities import html5
from typing import NamedTuple

KINDS = ("html", "wiki", "latex")

# Element names of HTML, and LaTeX commands that take no argument.
_TAGS = frozenset(
    "a abbr address article aside b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav nobr noscript object ol option p param picture pre q ref rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
_SYMBOLS = {
    "ldots": "…", "dots": "…", "textdegree": "°", "degree": "°", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "pi": "π", "mu": "µ", "sigma": "σ", "omega": "ω", "ge": "≥", "geq": "≥", "le": "≤", "leq": "≤", "neq": "≠",
    "times": "×", "cdot": "·", "pm": "±", "infty": "∞", "rightarrow": "→", "to": "→", "textbackslash": "\\", "S": "§", "copyright": "©", "quad": " ", "qquad": " ", "newline": "\n", "par": "\n\n", "noindent": "", "centering": "", "maketitle": "", "tableofcontents": "",
    "sum": "∑", "int": "∫", "approx": "≈", "lambda": "λ", "theta": "θ", "phi": "φ", "epsilon": "ε", "tau": "τ", "rho": "ρ", "Delta": "Δ", "Omega": "Ω", "LaTeX": "LaTeX", "TeX": "TeX", "item": "- ", "hline": "", "clearpage": "", "newpage": "", "bigskip": "", "medskip": "", "smallskip": "",
}
# Frequent function words, by which running text is told from labels and lists.
_STOP = frozenset(
    "af at blev da de den der det dig du efter en er et for fra han har havde hun hvor i ikke jeg kan kun man med men mod når og om op på ved var som så sig sin til under ud vi er att av blev de den det ett från för han har hade hon inte jag kan med men mot när och om på vid var som så sig till under ut vi är å ble etter fra ikke jeg mot når og på ved til ut "
    "a an and are as at be by for from had has he her his in is it its not of on or she that the their they this to was were which with der die das und ist von zu den mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei le la les de des du et est en un une que qui dans pour pas sur au par plus ne se ce il sont avec el los las y que se por un una con no su para es al lo como "
    "и в не на что с он как по это но из у за".split()
)

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*(?:\n|$)", re.M)
_TICKS = re.compile(r"`+")
_COMMENT = re.compile(r"<!--|-->")
_VERBATIM = re.compile(r"<(/?)(pre|code|script|style)\b([^<>]*)>", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s\"'=<>`]+))?)*)\s*(/?)>")
_REFERENCE = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]{1,31}));")
_DISPLAY = re.compile(r"(?<!\\)(?=\$\$)")
_INLINE = re.compile(r"(?<![\\$\w])\$(?![\s$])((?:[^$\n\\]++|\\.)++)(?<!\s)\$(?![\d$])")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_BLANK = re.compile(r"\n(?=[ \t]*\n)")
_MATHLIKE = re.compile(r"[=^_+<>/]|\\[A-Za-z]+|^\s*[A-Za-z]\s*$")
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_FORMULAS = re.compile(r"\\(begin|end)\{((?:equation|align|gather|multline|displaymath|math|eqnarray)\*?)\}")
_COMMAND = re.compile(r"(?<![\w:\\/])\\([A-Za-z]+)(\*?)")
_WIKI = re.compile(r"\{+|\}+|\[+|\]+|\|")
_TABLE = re.compile(r"^[ \t]*(\{\||\|\})[^\n]*", re.M)
_CELL_STYLE = re.compile(r"[^|\[\]{}]*=[^|\[\]]*\|(?!\|)")
_HEADING = re.compile(r"^(={2,6})([^=\n][^\n]*)$", re.M)
_QUOTES = re.compile(r"'{2,}|\n")
_FILE = re.compile(r"^(?:fil|file|image|billede|bild|datei|fichier|archivo|imagen|kategori|category|kategorie|catégorie|categoría)\s*:", re.I)
_AUTOLINK = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>|<[\w.+-]+@[\w.-]+>")
_MARK = "\ue000"
#: Private-use marks around what came from a container, and around the text of a wiki link.
_IN, _OUT, _LINKED, _UNLINKED = "\ue001", "\ue002", "\ue003", "\ue004"
_PRIVATE = re.compile("[\ue000-\ue004]")
# Elements that group things rather than hold running text.
_CONTAINERS = frozenset("nav aside header footer form menu select table ul ol dl div".split())


def code_spans(text: str) -> list[tuple[int, int]]:
    """Ranges of fenced blocks (an unclosed one runs to the end) and of backtick spans outside them."""
    out, at = [], 0
    fence = _FENCE.search(text)
    while fence:
        mark = fence.group(1)
        close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", re.M).search(text, fence.end())
        out.append((fence.start(), close.end() if close else len(text)))
        at = out[-1][1]
        fence = _FENCE.search(text, at)
    spans, begin = [], 0
    for lo, hi in [*out, (len(text), len(text))]:
        runs = list(_TICKS.finditer(text, begin, lo))
        closers: dict[int, list[int]] = {}
        for k in range(len(runs) - 1, -1, -1):
            closers.setdefault(len(runs[k].group()), []).append(k)
        k = 0
        while k < len(runs):
            own = closers[len(runs[k].group())]
            while own and own[-1] <= k:
                own.pop()
            if own and "\n\n" not in text[runs[k].end() : runs[own[-1]].start()]:
                spans.append((runs[k].start(), runs[own[-1]].end()))
                k = own[-1] + 1
            else:
                k += 1
        begin = hi
    return sorted(out + spans)


class _Reader:
    """One text on its way to clean Markdown; protected stretches stand in it as private-use marks.

    Every step rewrites stretches of the text, and where one was markup its place and kind are kept as a tag that moves
    along with the text, so that in the end each block knows what was found in it.
    """

    def __init__(self, text: str):
        self.kept: list[str] = []
        self.counts = dict.fromkeys(KINDS, 0)
        self.tags: list[tuple[int, str]] = []
        parts, at = [], 0
        for lo, hi in code_spans(text):
            parts += [text[at:lo], self.keep(text[lo:hi])]
            at = hi
        self.text = "".join([*parts, text[at:]])

    def keep(self, piece: str) -> str:
        self.kept.append(piece)
        return f"{_MARK}{len(self.kept) - 1}{_MARK}"

    def rewrite(self, edits: list, kind: str | None = None) -> None:
        """Puts (start, end, new text) in place, in order; with a kind each of them was markup."""
        if not edits:
            return
        out, tags, at, moved, t = [], [], 0, 0, 0
        for start, end, new in edits:
            while t < len(self.tags) and self.tags[t][0] < start:
                tags.append((self.tags[t][0] + moved, self.tags[t][1]))
                t += 1
            while t < len(self.tags) and self.tags[t][0] < end:
                tags.append((start + moved, self.tags[t][1]))
                t += 1
            if kind:
                tags.append((start + moved, kind))
            out += [self.text[at:start], new]
            at, moved = end, moved + len(new) - (end - start)
        self.tags = tags + [(p + moved, k) for p, k in self.tags[t:]]
        self.text = "".join([*out, self.text[at:]])
        if kind:
            self.counts[kind] += len(edits)

    def sub(self, pattern: re.Pattern, kind: str | None, make) -> None:
        edits = [(m.start(), m.end(), new) for m in pattern.finditer(self.text) if (new := make(m)) is not None]
        self.rewrite(edits, kind)

    def pair(self, pairs: list[tuple[int, int, int, int]], kind: str, make) -> None:
        """Rewrites what lies between paired marks: (start, start of the body, its end, end)."""
        self.rewrite([(start, end, new) for start, lo, hi, end in pairs if (new := make(self.text[lo:hi])) is not None], kind)

    def restored(self, text: str) -> str:
        mark = re.compile(f"{_MARK}(\\d+){_MARK}")
        out, waiting = [], [(text, False)]
        while waiting:
            piece, kept = waiting.pop()
            if kept:
                piece = self.kept[int(piece)] if int(piece) < len(self.kept) else ""
            parts = mark.split(piece)
            if len(parts) == 1:
                out.append(piece)
            else:
                waiting += [(x, k % 2 == 1) for k, x in reversed(list(enumerate(parts)))]
        return "".join(out)

    def stays(self, block: str) -> bool:
        """Headings, code, formulas, and lists and tables that are not mostly links."""
        return self.protects(block) or bool(re.match(r"\s*#{1,6} ", block)) or _is_list(block) and not _mostly_links(block)

    def protects(self, block: str) -> bool:
        """Whether there is code or a formula in it."""
        return any(self.kept[int(k)].lstrip()[:1] in ("`", "~", "$") for k in re.findall(f"{_MARK}(\\d+){_MARK}", block) if int(k) < len(self.kept))

    # -- LaTeX

    def formula(self, body: str, display: bool) -> str:
        body = body.strip()
        return self.keep(f"$${body}$$" if display else f"${body}$")

    def latex(self) -> None:
        self.pair(_environments(self.text), "latex", lambda body: self.formula(body, True))
        at = [m.start() for m in _DISPLAY.finditer(self.text)]
        self.pair(_paired(self.text, at, at), "latex", lambda body: self.formula(body, True))
        self.pair(_paired(self.text, *_places(self.text, r"\[", r"\]")), "latex", lambda body: self.formula(body, True) if _MATHLIKE.search(body) else None)
        self.pair(_paired(self.text, *_places(self.text, r"\(", r"\)")), "latex", lambda body: self.formula(body, False))
        self.sub(_INLINE, "latex", lambda m: self.formula(m.group(1), False))
        self.sub(_ENVIRONMENT, "latex", lambda m: "")
        self.commands()

    def commands(self) -> None:
        """Rewritten commands; read from the last to the first, so that those in an argument are done before its command."""
        text = self.text
        close = _closers(text)
        done: list[tuple[int, int, list, int]] = []
        for m in reversed(list(_COMMAND.finditer(text))):
            name, args, end = m.group(1), [], m.end()
            while end in close:
                if text[end] == "{":
                    args.append((end + 1, close[end]))
                end = close[end] + 1
            if not args and name not in _SYMBOLS:
                continue
            if not args:
                end = m.end()
            inner, count = [], 1
            for lo, hi in args:
                pieces, at = [], lo
                while done and done[-1][0] < hi:
                    start, stop, new, n = done.pop()
                    if start >= lo:
                        pieces += [text[at:start], new]
                        at, count = stop, count + n
                inner.append([*pieces, text[at:hi]])
            while done and done[-1][0] < end:
                done.pop()
            done.append((m.start(), end, self.command(name, inner), count))
        self.rewrite([(start, stop, _flat([new])) for start, stop, new, _ in reversed(done)], "latex")
        self.counts["latex"] += sum(n - 1 for *_, n in done)

    def command(self, name: str, inner: list[list]) -> list:
        if name in _SYMBOLS:
            return [_SYMBOLS[name], *inner]
        body = inner[-1] if inner else []
        levels = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
        if name in levels:
            return [f"{'#' * levels[name]} ", body]
        if name in ("textbf", "bf"):
            return ["**", body, "**"]
        if name in ("emph", "textit", "textsl", "it"):
            return ["*", body, "*"]
        if name in ("cite", "citep", "citet", "ref", "label", "eqref", "index", "pageref", "bibliography", "usepackage", "documentclass", "includegraphics", "vspace", "hspace"):
            return []
        if name == "href" and len(inner) > 1:
            return ["[", inner[1], "](", inner[0], ")"]
        if name == "frac" and len(inner) > 1:
            return [self.keep(f"$\\frac{{{_flat(inner[0])}}}{{{_flat(inner[1])}}}$")]
        return body

    # -- MediaWiki

    def wiki(self) -> None:
        self.marks()
        self.tables()
        self.sub(_HEADING, "wiki", self.heading)
        self.quotes()

    def marks(self) -> None:
        """Templates and links by a stack of open marks; an unclosed one is plain text of what it stands in."""
        text, stack, waiting, at = self.text, [_Open("")], {"{{": 0, "[[": 0}, 0
        edits: list[tuple[int, int, list | None]] = []
        for m in _WIKI.finditer(text):
            stack[-1].add(text[at : m.start()])
            at, run, lo = m.end(), m.group(), m.start()
            if run == "|":
                stack[-1].pieces.append(run)
            elif run[0] in "{[":
                if len(run) % 2:
                    stack[-1].add(run[0])
                for k in range(len(run) // 2):
                    stack.append(_Open(run[0] * 2, lo + len(run) % 2 + 2 * k))
                    waiting[run[0] * 2] += 1
            else:
                for k in range(len(run) // 2):
                    self.close(stack, waiting, "{{" if run[0] == "}" else "[[", run[0] * 2, lo + 2 * k + 2, edits)
                if len(run) % 2:
                    stack[-1].add(run[0])
        self.rewrite([(lo, hi, _flat([new])) for lo, hi, new in edits], "wiki")

    def close(self, stack: list[_Open], waiting: dict[str, int], opener: str, closer: str, end: int, edits: list) -> None:
        if not waiting[opener]:
            stack[-1].add(closer)
            return
        k = len(stack) - 1
        while stack[k].mark != opener:
            k -= 1
        own = stack[k]
        for f in stack[k:]:
            waiting[f.mark] -= 1
        for f in stack[k + 1 :]:
            own.take(f, [f.mark, *f.pieces])
        del stack[k:]
        new = self.template(own) if opener == "{{" else self.link(own)
        if new is None:
            stack[-1].take(own, [[opener, *own.pieces, closer]])
            return
        inner = 0
        while edits and edits[-1][0] >= own.start:
            edits.pop()
            inner += 1
        # what lies within it was counted when it was closed, as this one is when the text is rewritten
        self.counts["wiki"] += inner
        edits.append((own.start, end, new))
        stack[-1].pieces += [new] if new else []

    def template(self, own: _Open) -> list | None:
        name, *args = own.arguments()
        if own.braces or own.blank or not name:
            return None
        named = [(k, _named(a)) for k, a in enumerate(args)]
        if any(x for _, x in named):
            flag = f"{_MARK}b{_MARK}"
            lines: list = []
            for k, x in named:
                if x:
                    # every line of a value belongs to the box
                    value = [v.replace("\n", f"\n{flag}") if isinstance(v, str) else v for v in x[1]]
                    lines += [f"\n{flag}- ", x[0], ": ", value]
                elif args[k]:
                    lines += ["\n", args[k]]
            return [lines[0][1:], *lines[1:]]
        if isinstance(name[0], str) and re.match(r"(?:kilde|source|cite|ref|citation|fact)\b", name[0], re.I):
            return []
        return [_IN, *[x for a in args for x in (a, " ")][:-1], _OUT]

    def link(self, own: _Open) -> list | None:
        target, *rest = own.arguments()
        if own.brackets or own.lines or own.pieces[:1] in ([], ["|"]):
            return None
        if target and isinstance(target[0], str) and _FILE.match(target[0]):
            return []
        if not (rest and rest[-1]) and all(isinstance(x, str) for x in target):
            target = ["".join(target).rsplit("#", 1)[-1]]
        return [_LINKED, rest[-1] if rest and rest[-1] else target, _UNLINKED]

    def heading(self, m: re.Match) -> str | None:
        line = m.group(2).rstrip(" \t")
        body = line.rstrip("=")
        return f"{m.group(1).replace('=', '#')} {body.strip(' ' + chr(9))}" if body and len(line) - len(body) == len(m.group(1)) else None

    def quotes(self) -> None:
        text, runs = self.text, list(_QUOTES.finditer(self.text))
        follows: list[int | None] = [None] * len(runs)
        nearest: dict[int, int] = {}
        for k in range(len(runs) - 1, -1, -1):
            lo, n = runs[k].start(), len(runs[k].group())
            if text[lo] == "\n":
                nearest = {}
                continue
            follows[k] = nearest.get(n)
            if lo and not text[lo - 1].isspace():
                nearest[n] = k
        pairs, at = [], 0
        for run, k in zip(runs, follows):
            lo, hi = run.span()
            if k is None or lo < at or hi - lo not in (2, 3, 5) or text[hi].isspace() or lo and (text[lo - 1].isalnum() or text[lo - 1] == "_"):
                continue
            at = runs[k].end()
            pairs.append((lo, lo, at, at))
        mark = {2: "*", 3: "**", 5: "***"}

        def quoted(piece: str) -> str:
            n = len(piece) - len(piece.lstrip("'"))
            return f"{mark[n]}{piece[n:-n]}{mark[n]}"

        self.pair(pairs, "wiki", quoted)

    def tables(self) -> None:
        """Tables from their opening to the next closing line; one that is never closed ends with its last row."""
        edits, at, opened = [], 0, None
        for m in _TABLE.finditer(self.text):
            if m.group(1) == "{|":
                if opened is not None:
                    edits.append(self.unclosed(opened, m.start()))
                opened = m
            elif opened is not None:
                close = m.start() + m.group().index("|}") + 2
                edits.append((opened.start(), close, self.table(self.text[opened.end() : m.start()])))
                opened = None
        if opened is not None:
            edits.append(self.unclosed(opened, len(self.text)))
        self.rewrite([e for e in edits if e[0] >= at], "wiki")

    def unclosed(self, opened: re.Match, limit: int) -> tuple[int, int, str]:
        rows = re.compile(r"(?:\n[ \t]*[|!][^\n]*)*").match(self.text, opened.end(), limit)
        return opened.start(), rows.end(), self.table(rows.group()) if rows.group() else ""

    def table(self, body: str) -> str:
        """A pipe table; lines that go on with a cell belong to it, and a caption stands before the table."""
        rows: list[list[str]] = [[]]
        captions = []
        for line in body.split("\n"):
            line = line.strip()
            if line.startswith("|-"):
                rows.append([])
            elif line.startswith("|+"):
                captions.append(line[2:].strip())
            elif line[:1] in ("|", "!"):
                cells = (_CELL_STYLE.sub("", c, count=1) if _CELL_STYLE.match(c) else c for c in re.split(r"\|\||!!", line[1:]))
                rows[-1] += [c.strip() for c in cells]
            elif line:
                cells = next((r for r in reversed(rows) if r), rows[-1])
                cells[-1:] = [f"{cells[-1]} {line}".strip() if cells else line]
        head = "".join(f"{c}\n\n" for c in captions if c)
        return f"\n{_IN}\n{head}{_pipe_table([r for r in rows if r])}\n{_OUT}\n"

    # -- HTML

    def comments(self) -> None:
        """Comments go; of one that is never closed only the mark goes, for what follows may be running text."""
        edits, opened = [], None
        for m in _COMMENT.finditer(self.text):
            if m.group() == "<!--":
                opened = m if opened is None else opened
            elif opened is not None and m.start() >= opened.end():
                edits.append((opened.start(), m.end(), ""))
                opened = None
        if opened is not None:
            edits.append((opened.start(), opened.end(), ""))
        self.rewrite(edits, "html")

    def verbatim(self) -> None:
        """Code elements become code spans and blocks, scripts and styles go; an element that is never closed is a mere tag."""
        edits: list[tuple[int, int, str]] = []
        opened: dict[str, re.Match] = {}
        for m in _VERBATIM.finditer(self.text):
            name = m.group(2).lower()
            if not m.group(1):
                if not m.group(3).endswith("/"):
                    opened.setdefault(name, m)
                continue
            o = opened.pop(name, None)
            if o is None:
                continue
            while edits and edits[-1][0] >= o.start():
                edits.pop()
            body = self.text[o.end() : m.start()]
            new = ""
            if name in ("pre", "code"):
                body = html.unescape(self.restored(_VERBATIM.sub("", body)))
                if name == "pre" or "\n" in body:
                    fence = "`" * max(3, 1 + max((len(t) for t in _TICKS.findall(body)), default=0))
                    new = f"\n\n{self.keep(f'{fence}{chr(10)}{body.strip(chr(10))}{chr(10)}{fence}')}\n\n"
                elif body.strip():
                    tick = "`" * (1 + max((len(t) for t in _TICKS.findall(body)), default=0))
                    new = self.keep(f"{tick}{body}{tick}")
            edits.append((o.start(), m.end(), new))
            # an element that was opened within this one is done
            opened = {n: x for n, x in opened.items() if x.start() < o.start()}
        self.rewrite(edits, "html")

    def markup(self) -> None:
        self.sub(_AUTOLINK, None, lambda m: self.keep(m.group()))
        edits: list[list] = []
        link: list[tuple[int, str | None]] = []
        opened: list[tuple[str, int]] = []
        lists: list[int | None] = []
        waiting = dict.fromkeys(_CONTAINERS, 0)
        for m in _TAG.finditer(self.text):
            name, closing = m.group(2).lower(), bool(m.group(1))
            if name not in _TAGS:
                continue
            new = ""
            if name in _CONTAINERS:
                new = "\n\n"
                # only an element that is closed is a container; until then its place stays empty
                if not closing:
                    opened.append((name, len(edits)))
                    waiting[name] += 1
                else:
                    while waiting[name]:
                        last, place = opened.pop()
                        waiting[last] -= 1
                        if last == name:
                            edits[place][2] += f"{_IN}\n"
                            new = f"\n{_OUT}\n\n"
                            break
                if name in ("ul", "ol"):
                    if closing:
                        lists = lists[:-1]
                    else:
                        start = re.search(r"start\s*=\s*[\"']?(\d{1,6})", m.group(3))
                        lists.append(int(start.group(1)) if start else 1 if name == "ol" else None)
            elif re.fullmatch("h[1-6]", name):
                new = "\n\n" if closing else f"\n\n{'#' * int(name[1])} "
            elif name == "li":
                if not closing:
                    number = lists[-1] if lists else None
                    new = f"\n{'- ' if number is None else f'{number}. '}"
                    if number is not None:
                        lists[-1] = number + 1
            elif name == "br":
                new = "\n"
            elif name in ("p", "blockquote", "section", "article", "pre"):
                new = "\n\n"
            elif name == "tr":
                new = "" if closing else "\n|"
            elif name in ("td", "th"):
                new = " |" if closing else " "
            elif name in ("b", "strong"):
                new = "**"
            elif name in ("i", "em"):
                new = "*"
            elif name == "sup":
                new = "" if closing else "^"
            elif name == "sub":
                new = "" if closing else "_"
            elif name == "a":
                href = re.search(r"href\s*=\s*[\"']?([^\"'\s>]+)", m.group(3))
                if not closing:
                    link.append(href.group(1) if href else None)
                    new = "[" if href else ""
                elif link:
                    target = link.pop()
                    new = f"]({target})" if target else ""
            edits.append([m.start(), m.end(), new])
        self.rewrite(edits, "html")

        def reference(m: re.Match) -> str | None:
            if m.group(3) and f"{m.group(3)};" not in html5:
                return None
            return html.unescape(m.group())

        self.sub(_REFERENCE, "html", reference)


class _Open:
    """An open mark (none for the text itself) with the pieces read since, and what lies in them outside inner marks."""

    def __init__(self, mark: str, start: int = 0):
        self.mark, self.start, self.pieces = mark, start, []
        self.braces = self.brackets = self.lines = self.blank = False

    def add(self, piece: str) -> None:
        if piece:
            self.pieces.append(piece)
            self.braces |= piece[0] in "{}"
            self.brackets |= piece[0] in "[]"
            self.lines |= "\n" in piece
            self.blank |= "\n\n" in piece

    def take(self, other: _Open, pieces: list) -> None:
        """The pieces of a mark that turned out to be plain text."""
        self.pieces += pieces
        self.braces |= other.braces or other.mark == "{{"
        self.brackets |= other.brackets or other.mark == "[["
        self.lines |= other.lines
        self.blank |= other.blank

    def arguments(self) -> list[list]:
        out: list[list] = [[]]
        for x in self.pieces:
            if x == "|":
                out.append([])
            else:
                out[-1].append(x)
        return [_trimmed(a) for a in out]


def _trimmed(pieces: list) -> list:
    lo, hi = 0, len(pieces)
    while lo < hi and isinstance(pieces[lo], str) and not pieces[lo].strip():
        lo += 1
    while lo < hi and isinstance(pieces[hi - 1], str) and not pieces[hi - 1].strip():
        hi -= 1
    out = pieces[lo:hi]
    if out and isinstance(out[0], str):
        out[0] = out[0].lstrip()
    if out and isinstance(out[-1], str):
        out[-1] = out[-1].rstrip()
    return out


def _named(pieces: list) -> tuple[list, list] | None:
    """Name and value of an argument with an equals sign of its own."""
    for k, x in enumerate(pieces):
        if isinstance(x, str) and "=" in x:
            name, value = x.split("=", 1)
            return _trimmed([*pieces[:k], name]), _trimmed([value, *pieces[k + 1 :]])
    return None


def _flat(pieces: list) -> str:
    out, waiting = [], [iter(pieces)]
    while waiting:
        for x in waiting[-1]:
            if isinstance(x, list):
                waiting.append(iter(x))
                break
            out.append(x)
        else:
            waiting.pop()
    return "".join(out)


def _places(text: str, opener: str, closer: str) -> tuple[list[int], list[int]]:
    return [m.start() for m in re.finditer(re.escape(opener), text)], [m.start() for m in re.finditer(re.escape(closer), text)]


def _paired(text: str, openers: list[int], closers: list[int]) -> list[tuple[int, int, int, int]]:
    """Each opener (of two characters, as the closer) with the next closer behind at least one character, if no blank line is between."""
    blanks = [m.start() for m in _BLANK.finditer(text)] if openers else []
    out, at = [], 0
    for start in openers:
        if start < at:
            continue
        k, b = bisect_left(closers, start + 3), bisect_left(blanks, start + 2)
        if k < len(closers) and not (b < len(blanks) and blanks[b] < closers[k]):
            at = closers[k] + 2
            out.append((start, start + 2, closers[k], at))
    return out


def _environments(text: str) -> list[tuple[int, int, int, int]]:
    """Formula environments, each end with the last begin of its name; of those within each other the outer one."""
    begun: dict[str, re.Match] = {}
    pairs = []
    for m in _FORMULAS.finditer(text):
        if m.group(1) == "begin":
            begun[m.group(2)] = m
        elif m.group(2) in begun:
            b = begun.pop(m.group(2))
            pairs.append((b.start(), b.end(), m.start(), m.end()))
    out: list[tuple[int, int, int, int]] = []
    for pair in sorted(pairs):
        if not out or pair[0] >= out[-1][3]:
            out.append(pair)
    return out


def _closers(text: str) -> dict[int, int]:
    """Where each bracket closes, within its paragraph; a square one not beyond the braces it stands in."""
    close: dict[int, int] = {}
    curly: list[int] = []
    square: list[int] = []
    for m in re.finditer(r"[\[\]{}]|\n\n", text):
        c, k = m.group(), m.start()
        if c == "{":
            curly.append(k)
        elif c == "[":
            square.append(k)
        elif c == "]":
            if square:
                close[square.pop()] = k
        elif c == "}":
            if curly:
                close[curly[-1]] = k
                while square and square[-1] > curly[-1]:
                    square.pop()
                curly.pop()
        else:
            curly, square = [], []
    return close


def _pipe_table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join(["", line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:]), ""])


_URLS = re.compile(r"\[([^\[\]\n]*+)\]\([^()\n]*+\)")
_WORDS = re.compile(r"[^\W\d_]+")
_ITEM = re.compile(r"[ \t]*(?:[-*+|]|\d+[.)])")
_STOPPED = re.compile(r"[^\W\d_][.!?…](?:\s|$)|[。！？]")
#: A block with fewer characters is short; with more than LONG and enough stop words it is text; stop words and links are shares of words and characters.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINK_HIGH = 60, 200, 0.10, 0.22, 0.4
#: A box's value with fewer words (or letters, where words are not set apart) is a mere entry.
FEW_WORDS, FEW_LETTERS = 4, 8
_FIELD = re.compile(r"\n- [^:\n]*:")


def _mostly_links(block: str) -> bool:
    """Whether more than a fixed share of the characters is the text of links."""
    linked = sum(len(m.group(1)) for m in _URLS.finditer(block))
    return linked / max(len(_URLS.sub(r"\1", block)), 1) > LINK_HIGH


def _is_list(block: str) -> bool:
    """Whether every line is a list item or a table row."""
    return all(_ITEM.match(line) for line in block.split("\n") if line.strip())


_UNLISTED = re.compile("[\u0600-\u06ff\u0900-\u0e7f\u3040-\u9fff]")


def _unlisted(plain: str) -> bool:
    """Whether there are letters of a script in which no stop words are listed."""
    return bool(_UNLISTED.search(plain))


def _reads(value: str) -> bool:
    """Whether a box's value is running text: long enough, with stop words, the end of a sentence or letters of another script."""
    words = _WORDS.findall(value)
    if _unlisted(value):
        return sum(map(len, words)) >= FEW_LETTERS
    return len(words) >= FEW_WORDS and (sum(w.lower() in _STOP for w in words) / len(words) >= STOP_LOW or bool(_STOPPED.search(value)))


def _first_label(block: str, boxed: bool) -> str:
    """text, residue, near (leaning to text) or short: the first pass, from the block alone."""
    plain = _URLS.sub(r"\1", block)
    words = _WORDS.findall(plain)
    if boxed:
        values = _FIELD.sub("\n", f"\n{block}").split("\n")
        return "near" if any(_reads(_URLS.sub(r"\1", v)) and not _mostly_links(v) for v in values) else "residue"
    if not words:
        return "short"
    if _mostly_links(block):
        return "residue"
    if len(plain) < SHORT:
        return "short"
    if _unlisted(plain):
        return "text"
    share = sum(w.lower() in _STOP for w in words) / len(words)
    if share >= STOP_HIGH:
        return "text" if len(plain) > LONG else "near"
    # lists and tables have no stop words, nor have sentences in a language that is not listed
    bare = len(plain) > LONG and share == 0 and not _STOPPED.search(plain) and not _is_list(plain)
    return "near" if share >= STOP_LOW else ("residue" if bare else "short")


def label_blocks(blocks: list[str], boxed: list[bool]) -> list[str]:
    """text or residue for each block. Second pass: a short block takes the label that its decided neighbours share;
    where they differ, and for near ones, one text neighbour is enough, and a document without any decided block is text."""
    first = [_first_label(b, x) for b, x in zip(blocks, boxed)]
    before, last = [], None
    for x in first:
        before.append(last)
        last = x if x in ("text", "residue") else last
    after, last = [None] * len(first), None
    for k in range(len(first) - 1, -1, -1):
        after[k] = last
        last = first[k] if first[k] in ("text", "residue") else last
    out = []
    for k, x in enumerate(first):
        if x in ("text", "residue"):
            out.append(x)
        elif x == "near":
            out.append("text")
        else:
            out.append("residue" if {before[k], after[k]} == {"residue"} else "text")
    return out


class Block(NamedTuple):
    """A block of the rewritten text: its label, the kinds of markup found in it, and whether it was left out."""

    label: str
    kinds: list[str]
    left_out: bool


class Cleaned(NamedTuple):
    text: str | None
    counts: dict[str, int]
    blocks: list[Block]


def read(text: str | None) -> Cleaned:
    """Clean text, residue found by kind, and the labelled blocks. Null gives null, no residue and no block.

    Markup that leaves nothing behind (a comment of its own, say) is a block with the label "gone".
    """
    if text is None:
        return Cleaned(None, dict.fromkeys(KINDS, 0), [])
    reader = _Reader(_PRIVATE.sub("", text.replace("\r\n", "\n").replace("\r", "\n")))
    reader.comments()
    reader.verbatim()
    reader.latex()
    reader.markup()
    reader.wiki()
    flag = f"{_MARK}b{_MARK}"
    raw, contained, kinds, gone, depth, t = [], [], [], [], 0, 0
    edges = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(reader.text)]
    for lo, hi in zip([0, *[e for _, e in edges]], [*[e for e, _ in edges], len(reader.text)]):
        inside = True
        b = reader.text[lo:hi]
        for piece in re.split(f"([{_IN}{_OUT}])", b):
            if piece in (_IN, _OUT):
                depth += 1 if piece == _IN else -1
            elif piece.strip() and not depth:
                inside = False
        b = b.replace(_IN, "").replace(_OUT, "").strip("\n")
        found = set()
        while t < len(reader.tags) and reader.tags[t][0] <= hi:
            (found.add if reader.tags[t][0] >= lo and b.strip() else gone.append)(reader.tags[t][1])
            t += 1
        if b.strip():
            raw.append(b)
            contained.append(inside)
            kinds.append(sorted(found))
    gone += [k for _, k in reader.tags[t:]]
    boxed = [flag in b and all(line.startswith(flag) for line in b.split("\n") if line.strip()) for b in raw]
    raw = [b.replace(flag, "") for b in raw]
    # to the rules a wiki link is a link like any other
    seen = [b.replace(_LINKED, "[").replace(_UNLINKED, "]()") for b in raw]
    labels = label_blocks(seen, boxed)
    plain = [b.replace(_LINKED, "").replace(_UNLINKED, "") for b in raw]
    # only what came from a markup container may be left out: running text is never lost
    out = [label == "residue" and (box or inside) and not (reader.protects(b) if box else reader.stays(b)) for b, label, box, inside in zip(seen, labels, boxed, contained)]
    kept = [b for b, leave in zip(plain, out) if not leave]
    body = "\n\n".join(re.sub(r"[ \t]{2,}", " ", b).rstrip() if not re.match(r"\s", b) else b for b in kept)
    blocks = [Block(*x) for x in zip(labels, kinds, out)]
    return Cleaned(reader.restored(body), reader.counts, blocks + ([Block("gone", sorted(set(gone)), True)] if gone else []))


def clean(text: str | None) -> tuple[str | None, dict[str, int], int]:
    """Clean text, residue found by kind, and the number of blocks left out (see ``read``)."""
    done = read(text)
    return done.text, done.counts, sum(b.left_out and b.label != "gone" for b in done.blocks)
