"""Markup residue in text: a tree-structured graphical model over blocks and candidate pieces of markup.

A text is a tree: the root, its blocks (paragraphs, fences, environments, tables), and inside each the pieces that may be
markup of HTML, Markdown, wiki or LaTeX, nested where one encloses another. Every node is markup or plain. Pieces have
features of their kind and surroundings; parent-child potentials tie pieces to their block and blocks to the page, so that a
doubtful piece is read as its neighbours are. Sum-product messages go up and down the tree and give each piece the marginal
probability of being markup. Weights are trained on labelled pages (``train_markup``) and kept in ``markup_weights.json``.

Pieces above one half are rewritten on the tree, innermost first: headings become lines that begin with ``§``, lists ``- x`` or
``1. x``, code blocks lines indented by four blanks, table cells are parted by tabs, formulas follow ``formula:``, links,
emphasis and inline code keep their text. What merely looks like markup stays as it is. What code holds (fences, ``pre``,
``verbatim``, ``\\verb``, inline code, ``nowiki``), decoded entities, escaped characters and formulas are opaque: they are put
away while the rest is rewritten, so nothing in them is ever taken for markup. Markup that only shows once what lies inside
it is rewritten (nested templates) is looked for again until none is left; each turn uses up markup characters, so it ends.
"""

from __future__ import annotations

import html
import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import free_name

WEIGHTS = Path(__file__).with_name("markup_weights.json")
#: Element names of HTML and of wiki pages, environments and commands of LaTeX that occur in text.
TAGS = frozenset("a abbr article aside audio b big blockquote body br button caption center cite code col dd del details dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark math meta nav nobr nowiki object ol option p param pre q ref references s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr gallery includeonly noinclude poem syntaxhighlight source blink article".split())
BLOCK_TAGS = frozenset("p div section article blockquote ul ol dl table thead tbody tfoot header footer main nav figure details summary center form pre".split())
COMMANDS = frozenset("section subsection subsubsection chapter paragraph part title author date textbf textit emph texttt textsc textrm underline footnote cite citep citet ref eqref autoref pageref label url href item caption includegraphics begin end input include usepackage documentclass newcommand maketitle tableofcontents bibliography frac sqrt sum int prod alpha beta gamma delta epsilon lambda mu sigma theta pi omega leq geq neq cdot times infty mathbb mathbf mathrm text left right ldots dots quad qquad hline toprule midrule bottomrule centering noindent newline linebreak par small large bf it tt em LaTeX TeX verb multicolumn".split())

_CODE = [
    ("fence", re.compile(r"^[ \t]*(?P<f>```+|~~~+)[^\n]*\n(?P<in>.*?)(?:^[ \t]*(?P=f)[ \t]*$|\Z)", re.M | re.S)),
    ("verbatim", re.compile(r"\\begin\{(?P<e>verbatim\*?|lstlisting|minted|Verbatim)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?(?P<in>.*?)\\end\{(?P=e)\}", re.S)),
    ("pre", re.compile(r"<(?P<t>pre|syntaxhighlight|source)\b[^>]*>\s*(?:<code[^>]*>)?(?P<in>.*?)(?:</code>)?\s*</(?P=t)>", re.S | re.I)),
    ("verb", re.compile(r"\\verb\*?(?P<f>[^\w\s*{])(?P<in>[^\n]*?)(?P=f)")),
    ("nowiki", re.compile(r"<nowiki>(?P<in>.*?)</nowiki>", re.S | re.I)),
    ("code", re.compile(r"(?<!`)(?P<f>`{1,3})(?!`)(?P<in>[^`\n]+?)(?P=f)(?!`)")),
]
_MATH = [
    ("math_env", re.compile(r"\\begin\{(?P<e>equation\*?|align\*?|gather\*?|displaymath|math|eqnarray\*?)\}(?P<in>.*?)\\end\{(?P=e)\}", re.S)),
    ("math_block", re.compile(r"\$\$(?P<in>[^$]+?)\$\$", re.S)),
    ("math_bracket", re.compile(r"\\\[(?P<in>.+?)\\\]", re.S)),
    ("math_paren", re.compile(r"\\\((?P<in>.+?)\\\)")),
    ("math", re.compile(r"(?<![\\$\w])\$(?P<in>[^$\n]+?)\$(?![\w$])")),
]
_OTHER = [
    ("comment", re.compile(r"<!--.*?-->", re.S)),
    ("doctype", re.compile(r"<!DOCTYPE[^>]*>", re.I)),
    ("tag", re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:\s+[A-Za-z_:@][\w:.\-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*)\s*/?>")),
    ("entity", re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,8}|#\d{1,6}|#[xX][0-9A-Fa-f]{1,5});")),
    ("wiki_table", re.compile(r"^\{\|.*?^\|\}", re.M | re.S)),
    ("wiki_heading", re.compile(r"^[ \t]*(?P<f>={1,6})[ \t]*(?P<in>[^=\n][^\n]*?)[ \t]*(?P=f)[ \t]*$", re.M)),
    ("wiki_link", re.compile(r"\[\[(?P<in>[^\[\]\n]+)\]\]")),
    ("template", re.compile(r"\{\{(?P<in>[^{}\n]+)\}\}")),
    ("external", re.compile(r"\[(?P<url>(?:https?:|ftp:|mailto:)?//?[^\s\]]+)\s+(?P<in>[^\]\n]+)\](?!\()")),
    ("quotes", re.compile(r"(?<!')(?P<f>'{2,5})(?!')(?P<in>[^\n]+?)(?<!')(?P=f)(?!')")),
    ("wiki_indent", re.compile(r"^(?P<f>[:;]+)[ \t]+(?=\S)", re.M)),
    ("magic", re.compile(r"__(?:TOC|NOTOC|NOEDITSECTION|FORCETOC)__")),
    ("image", re.compile(r"!\[(?P<in>[^\]\n]*)\]\((?P<url>[^()\s]*(?:\([^()]*\))?[^()\s]*)(?:\s+\"[^\"]*\")?\)")),
    ("link", re.compile(r"(?<!!)\[(?P<in>[^\[\]\n]+)\]\((?P<url>[^()\s]*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)")),
    ("ref_link", re.compile(r"(?<!!)\[(?P<in>[^\[\]\n]+)\]\[(?P<url>[^\[\]\n]*)\]")),
    ("ref_def", re.compile(r"^[ \t]{0,3}\[(?P<in>[^\]\n^][^\]\n]*)\]:[ \t]*(?P<url>\S+)[^\n]*$", re.M)),
    ("foot_def", re.compile(r"^[ \t]{0,3}\[\^(?P<in>[^\]\n]+)\]:[ \t]*", re.M)),
    ("foot", re.compile(r"\[\^(?P<in>[^\]\s]+)\](?!:)")),
    ("autolink", re.compile(r"<(?P<in>(?:https?|ftp|mailto):[^>\s]+|[\w.+-]+@[\w-]+\.[\w.]+)>")),
    ("heading", re.compile(r"^[ \t]{0,3}(?P<f>#{1,6})[ \t]+(?P<in>[^\n]*?\S)[ \t]*$", re.M)),
    ("setext", re.compile(r"^(?P<in>[^\n|>#=\-][^\n]*)\n(?P<f>={3,}|-{3,})[ \t]*$", re.M)),
    ("attr", re.compile(r"[ \t]*\{(?P<in>[#.][A-Za-z][\w:.\-]*(?:\s+[#.][\w\-]+)*)\}")),
    ("quote", re.compile(r"^[ \t]{0,3}(?P<f>(?:>[ \t]?)+)(?=\S)", re.M)),
    ("rule", re.compile(r"^[ \t]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)),
    ("table_sep", re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M)),
    ("table_row", re.compile(r"^[ \t]*\|(?P<in>[^\n]+)\|[ \t]*$", re.M)),
    ("task", re.compile(r"(?<=[-*+] )\[(?P<in>[ xX])\](?= )")),
    ("bold", re.compile(r"(?P<f>\*\*|__)(?=\S)(?P<in>[^\n]+?)(?<=\S)(?P=f)")),
    ("italic", re.compile(r"(?<!\*)\*(?!\*)(?P<in>[^*\n]+?)\*(?!\*)")),
    ("under", re.compile(r"(?<![\w_])_(?P<in>[^_\n]+?)_(?![\w_])")),
    ("strike", re.compile(r"~~(?P<in>[^~\n]+)~~")),
    ("highlight", re.compile(r"==(?P<in>[^=\s][^=\n]*?)==(?!=)")),
    ("bbcode", re.compile(r"\[/?(?P<in>b|i|u|s|url|code|quote|img|color|size|list)(?:=[^\]]*)?\]", re.I)),
    ("environment", re.compile(r"\\(?:begin|end)\{(?P<in>[A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?")),
    ("command", re.compile(r"(?P<tie>~?)\\(?P<name>[A-Za-z]+)\*?(?P<opt>\[[^\]\n]*\])?(?P<arg>\{(?:[^{}]|\{[^{}]*\})*\})*")),
    ("escape", re.compile(r"\\(?P<in>[,%&#_$;!{} ~\\*`\[\]()>.+-])")),
    ("angle", re.compile(r"<(?P<in>[^<>\n]{1,80})>")),
    ("compare", re.compile(r"(?<=\w) [<>]=? (?=\w)")),
]
#: What a text must hold, one of each row at least, for a pattern to match in it at all.
_NEED = {
    "fence": ("```", "~~~"), "verbatim": ("\\begin",), "pre": ("<",), "verb": ("\\verb",), "nowiki": ("<",), "code": ("`",), "math_env": ("\\begin",), "math_block": ("$$",), "math_bracket": ("\\[",), "math_paren": ("\\(",), "math": ("$",),
    "comment": ("<!--",), "doctype": ("<!",), "tag": ("<",), "entity": ("&",), "wiki_table": ("{|",), "wiki_heading": ("=",), "wiki_link": ("[[",), "template": ("{{",), "external": ("[",), "quotes": ("''",), "wiki_indent": (":", ";"),
    "magic": ("__",), "image": ("![",), "link": ("](",), "ref_link": ("][",), "ref_def": ("]:",), "foot_def": ("[^",), "foot": ("[^",), "autolink": ("<",), "heading": ("#",), "setext": ("===", "---"), "attr": ("{",), "quote": (">",),
    "rule": ("*", "-", "_"), "table_sep": ("--",), "table_row": ("|",), "task": ("[",), "bold": ("**", "__"), "italic": ("*",), "under": ("_",), "strike": ("~~",), "highlight": ("==",), "bbcode": ("[",), "environment": ("\\",),
    "command": ("\\",), "escape": ("\\",), "angle": ("<",), "compare": ("<", ">"),
}
_PATTERN = dict(_CODE + _MATH + _OTHER)


@dataclass
class Piece:
    kind: str
    start: int
    end: int
    m: re.Match
    block: int = 0
    parent: int = -1
    feats: list[str] = field(default_factory=list)


def _features(kind: str, m: re.Match, text: str, closed: frozenset[str]) -> list[str]:
    """Cues of a candidate; ``closed`` holds the beginnings of the names of all closing tags."""
    if kind == "verb":
        kind = "verbatim"
    g = m.groupdict()
    inner = g.get("in") or ""
    before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    out = ["bias", kind]
    put = lambda cue, yes: out.append(f"{kind}:{cue}") if yes else None
    put("word-before", before.isalnum() or before != "" and before in ":\\/")
    put("word-after", after.isalnum())
    put("line-start", m.start() == 0 or text[m.start() - 1] == "\n")
    put("spaced", inner != inner.strip())
    put("numeric", bool(re.fullmatch(r"[\d\s.,%]+.*", inner)) and not re.search(r"[\\^_=+]", inner))
    put("long", len(inner) > 60 and kind in ("italic", "under", "bold", "quotes", "strike", "math", "code", "link", "angle"))
    put("under", kind == "bold" and g["f"] == "__")
    if kind == "tag":
        name = g["name"]
        put("known", name.lower() in TAGS)
        put("upper", name[0].isupper() and not name.isupper())
        put("attrs", bool(g["attrs"]) and "=" in g["attrs"])
        put("paired", bool(g["close"]) or name.lower() in closed)
    elif kind == "entity":
        put("known", html.unescape(m.group()) != m.group())
    elif kind in ("math", "math_block", "math_bracket", "math_paren"):
        put("tex", bool(re.search(r"\\[A-Za-z]+|[\^_]|=", inner)))
        put("price", bool(re.match(r"\d", inner)) and not re.search(r"[\\^_{}]", inner))
        put("letters", bool(re.fullmatch(r"[A-Za-z]|[A-Za-z]\([a-z\d]+\)", inner)))
        put("words", bool(re.search(r"\b[a-z]{4,} [a-z]{3,}", inner)))
    elif kind in ("italic", "under", "bold", "quotes", "highlight", "strike"):
        put("glob", bool(re.match(r"[.\w]*\.\w+|/", inner)) or bool(re.search(r"[\s/(]$", inner)))
        put("code", bool(re.search(r"[()=<>;{}\[\]]", inner)) and " " not in inner)
        put("alone", not before.strip() and (not after.strip() or after in ".,;:!?)"))
        put("op", inner[:1] == " " and inner[-1:] == " ")
    elif kind == "command":
        put("known", g["name"] in COMMANDS)
        put("arg", bool(g["arg"]))
        put("path", bool(re.search(r"(?:[A-Za-z]:|\\[\w.]*|\w)$", text[max(0, m.start() - 12) : m.start()])) or after == "\\" or text[m.end() : m.end() + 1] in ".\\")
        put("bare", not g["arg"] and not g["opt"])
    elif kind == "escape":
        put("regex", bool(re.search(r"[\w)\]]$", before)) and after.isalnum())
        put("tex", m.group()[1] in ",%&#_$;")
    elif kind == "heading":
        put("end-mark", inner.endswith("#"))
        put("code", bool(re.search(r"[;={}]$|^!", inner)))
        put("long", len(inner) > 90)
    elif kind in ("link", "ref_link", "image", "external"):
        put("url", bool(re.match(r"(?:https?:|ftp:|mailto:|[#./]|\.\.|[\w\-]+[./#])", g["url"] or "")))
        put("index", bool(re.fullmatch(r"[\d:, ]+|['\"]\w+['\"]", inner)))
    elif kind == "wiki_link":
        put("code", bool(re.search(r"[=;(){}]|^\s*-|^[\d., ]+$", inner)))
    elif kind == "template":
        put("code", bool(re.search(r"^\s|\s$", inner)) and "|" not in inner)
        put("piped", "|" in inner)
    elif kind == "wiki_heading":
        put("code", bool(re.search(r"[(){};]", inner)))
    elif kind == "table_row":
        put("cells", m.group().count("|") >= 3)
        put("or", "||" in inner)
    elif kind == "quote":
        put("shell", m.group().count(">") > 2)
    elif kind == "wiki_indent":
        put("deep", len(g["f"]) > 1)
    elif kind == "angle":
        put("generic", bool(re.search(r"[A-Z]|,|\d", inner)))
        put("word", bool(re.fullmatch(r"[a-z][\w\- ]*", inner)))
    elif kind == "attr":
        put("end", after in ("", "\n"))
    return out


_BLANK = re.compile(r"\n[ \t]*\n")
_CLOSING = re.compile(r"</([A-Za-z][A-Za-z0-9]*)")


class _Cover:
    """Whether a place lies inside one of some pieces."""

    def __init__(self, found: list[Piece], kinds: tuple[str, ...]):
        spans = sorted((p.start, p.end) for p in found if p.kind in kinds)
        self.starts, self.ends, far = [a for a, _ in spans], [], -1
        for _, e in spans:
            far = max(far, e)
            self.ends.append(far)

    def __contains__(self, at: int) -> bool:
        i = bisect_right(self.starts, at) - 1
        return i >= 0 and at < self.ends[i]


def _mask(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with nothing but line ends left in the spans."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub(r"[^\n]", "\0", text[a:b])]
        at = b
    return "".join(out) + text[at:]


_TEX = ("verbatim", "verb", "math_env", "math_bracket", "math_paren")
_INSIDE = {"environment": _TEX, "command": (*_TEX, "environment"), "escape": (*_TEX, "environment", "command")}


def pieces(text: str) -> tuple[list[Piece], int]:
    """Candidate pieces in order, with their block and the piece that encloses them; the number of blocks."""
    found: list[Piece] = []
    masked = text
    possible = lambda kind: any(x in masked for x in _NEED[kind])
    for kind, rx in _CODE:
        if possible(kind):
            hits = list(rx.finditer(masked))
            found += [Piece(kind, m.start(), m.end(), m) for m in hits]
            masked = _mask(masked, [m.span("in") for m in hits])
    for kind, rx in _MATH:
        if possible(kind):
            hits = [m for m in rx.finditer(masked) if "\0" not in m.group("in")]
            found += [Piece(kind, m.start(), m.end(), m) for m in hits]
            masked = _mask(masked, [m.span("in") for m in hits if kind != "math" or re.search(r"\\[A-Za-z]|[\^_{}=]", m.group("in"))])
    taken: set[tuple[int, int]] = {(p.start, p.end) for p in found}
    for kind, rx in _OTHER:
        if not possible(kind):
            continue
        cover = _Cover(found, _INSIDE.get(kind, ("autolink", "comment", "tag") if kind == "angle" else ()))
        at_tag = {p.start for p in found if p.kind in ("tag", "autolink")} if kind == "angle" else ()
        for m in rx.finditer(masked):
            s = m.start()
            if (s, m.end()) in taken or masked[s] == "\0" or s in cover or s in at_tag:
                continue
            taken.add((s, m.end()))
            found.append(Piece(kind, s, m.end(), m))
    found.sort(key=lambda p: (p.start, -p.end))
    cuts = [m.start() for m in _BLANK.finditer(text)]
    closed = frozenset(n[:i] for n in {x.lower() for x in _CLOSING.findall(masked)} for i in range(1, len(n) + 1)) if "</" in masked else frozenset()
    stack: list[int] = []
    for i, p in enumerate(found):
        p.block = bisect_left(cuts, p.start)
        while stack and found[stack[-1]].end < p.end:
            stack.pop()
        p.parent = stack[-1] if stack and found[stack[-1]].end >= p.end and found[stack[-1]].start <= p.start else -1
        stack.append(i)
        p.feats = _features(p.kind, p.m, masked, closed)
    return found, len(cuts) + 1


class Tree:
    """Binary tree-structured field: unary weights by feature, one potential per kind of edge (page, block, piece)."""

    EDGES = ("page", "block", "piece")

    def __init__(self, weights: dict[str, float], edges: dict[str, list[list[float]]]):
        self.w, self.e = weights, edges

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Tree:
        d = json.loads(path.read_text())
        return cls(d["weights"], d["edges"])

    def graph(self, found: list[Piece], blocks: int):
        """Parents (page 0, blocks, pieces), kind of the edge to the parent, unary scores of "markup"."""
        used = sorted({p.block for p in found})
        at = {b: 1 + i for i, b in enumerate(used)}
        first = 1 + len(used)
        parent = [-1] + [0] * len(used) + [first + p.parent if p.parent >= 0 else at[p.block] for p in found]
        edge = [""] + ["page"] * len(used) + ["piece" if p.parent >= 0 else "block" for p in found]
        get = self.w.get
        unary = [get("page", 0.0)] + [get("block", 0.0)] * len(used) + [sum(get(f, 0.0) for f in p.feats) for p in found]
        return parent, edge, unary, first

    def marginals(self, parent: list[int], edge: list[str], unary: list[float]):
        """Sum-product, upward then downward; node and edge marginals. Parents precede their children."""
        n = len(parent)
        up = np.ones((n, 2))
        pot = {k: np.exp(np.array(v)) for k, v in self.e.items()}
        local = np.stack([np.ones(n), np.exp(np.clip(unary, -30, 30))], 1)
        belief = local.copy()
        for i in range(n - 1, 0, -1):
            b = belief[i] / belief[i].sum()
            up[i] = pot[edge[i]] @ b
            up[i] /= up[i].sum()
            belief[parent[i]] = belief[parent[i]] * up[i]
            belief[parent[i]] /= belief[parent[i]].sum()
        full = belief.copy()
        full[0] /= full[0].sum()
        pair = np.zeros((n, 2, 2))
        for i in range(1, n):
            p = parent[i]
            rest = full[p] / up[i]
            b = belief[i] / belief[i].sum()
            joint = rest[:, None] * pot[edge[i]] * b[None, :]
            joint /= joint.sum()
            pair[i] = joint
            full[i] = joint.sum(0)
        return full[:, 1], pair

    def probabilities(self, found: list[Piece], blocks: int) -> np.ndarray:
        """Marginals of the pieces: ``marginals`` in ratios of the two states, one number a message."""
        parent, edge, unary, first = self.graph(found, blocks)
        n, pot = len(parent), {k: [math.exp(x) for row in v for x in row] for k, v in self.e.items()}
        belief = [math.exp(min(30.0, max(-30.0, u))) for u in unary]
        up = [1.0] * n
        for i in range(n - 1, 0, -1):
            a, b, c, d = pot[edge[i]]
            r = belief[i]
            up[i] = (c + d * r) / (a + b * r)
            belief[parent[i]] = min(1e250, max(1e-250, belief[parent[i]] * up[i]))
        full = belief[:]
        for i in range(1, n):
            a, b, c, d = pot[edge[i]]
            rest = full[parent[i]] / up[i]
            full[i] = (b + d * rest) / (a + c * rest) * belief[i]
        r = np.array(full[first:])
        return r / (1 + r)


def _indent(code: str) -> str:
    return "\n".join("    " + line if line.strip() else "" for line in code.strip("\n").split("\n"))


def _formula(tex: str) -> str:
    t = re.sub(r"\s+", " ", tex).strip()
    t = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", t)
    t = re.sub(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", t)
    t = re.sub(r"\\(?:text|mathrm|mathbf|mathbb|operatorname)\{([^{}]*)\}", r"\1", t)
    for a, b in (("\\cdot", "·"), ("\\times", "×"), ("\\leq", "≤"), ("\\geq", "≥"), ("\\neq", "≠"), ("\\infty", "∞"), ("\\ldots", "…"), ("\\dots", "…")):
        t = t.replace(a, b)
    t = re.sub(r"([_^])\{([^{}]*)\}", lambda m: m[1] + (m[2] if len(m[2]) < 2 or m[2].isalnum() else f"({m[2]})"), t)
    t = re.sub(r"\\[,;:! ]", " ", t)
    t = re.sub(r"\\([A-Za-z]+)\s*", r"\1 ", t)
    t = t.replace("\\\\", ";").replace("&", "").replace("{", "").replace("}", "").replace("$", "").replace("\\", "")
    return re.sub(r" +", " ", t).strip()


def _argument(m: re.Match) -> tuple[str, int]:
    """The command's last argument and where it begins."""
    a, b = m.span("arg")
    return (m.string[a + 1 : b - 1], a + 1) if a >= 0 else ("", m.end())


#: Elements whose text is code, and those that only colour it.
CODE_TAGS, _WRAPPERS = frozenset(("code", "tt", "kbd", "samp")), re.compile(r"</(?:span|code|a|font)>|<(?:span|code|a|font)(?:\s[^<>]*)?>", re.I)


class Vault:
    """Texts put away under two private characters each, which are no markup, and brought back at the end."""

    USED = re.compile("[\U000F0000-\U0010FFFD]")
    MARK = re.compile("([\U000F0000-\U000FFFFD])([\U00100000-\U0010FFFD])")

    def __init__(self):
        self.texts: list[str] = []

    def put(self, text: str) -> str:
        if not text:
            return ""
        i = len(self.texts)
        self.texts.append(self.bring(text))
        return chr(0xF0000 + i // 60_000) + chr(0x100000 + i % 60_000)

    def bring(self, text: str) -> str:
        return self.MARK.sub(lambda m: self.texts[(ord(m[1]) - 0xF0000) * 60_000 + ord(m[2]) - 0x100000], text)


def edits(k: str, m: re.Match, text: str, before: str, keep: Callable[[str], str]) -> list[tuple[int, int, str]]:
    """Replacements that turn a piece of markup in ``text`` into plain text; ``keep`` makes a text opaque, ``before`` is the character in front."""
    g = m.groupdict()
    s, e = m.span()
    inner = text[slice(*m.span("in"))] if g.get("in") is not None else ""
    around = lambda left="", right="": [(s, m.start("in"), left), (m.end("in"), e, right)]
    if k in ("fence", "verbatim", "pre"):
        code = _indent(html.unescape(_WRAPPERS.sub("", inner)) if k == "pre" else inner)
        return [(s, e, ("" if before in ("", "\n") else "\n") + keep(code))]
    if k in ("code", "verb", "autolink"):
        return [(s, e, keep(inner))]
    if k == "nowiki":
        return [(s, e, keep(html.unescape(inner)))]
    if k in ("bold", "italic", "under", "strike", "quotes", "highlight"):
        return around()
    if k.startswith("math"):
        return [(s, e, keep("formula: " + _formula(inner) if k in ("math_env", "math_block", "math_bracket") else _formula(inner)))]
    if k in ("comment", "doctype", "magic", "rule", "table_sep", "attr", "ref_def", "bbcode"):
        return [(s, e, "")]
    if k == "tag":
        name, close = g["name"].lower(), bool(g["close"])
        if name in ("br", "hr"):
            return [(s, e, "\n")]
        if re.fullmatch(r"h[1-6]", name):
            return [(s, e, "\n" if close else "§" * int(name[1]) + " ")]
        if name == "li":
            return [(s, e, "" if close else "\n- ")]
        if name in ("td", "th"):
            return [(s, e, "\t" if close else "")]
        if name == "tr":
            return [(s, e, "\n" if close else "")]
        if name == "img" and (alt := re.search(r"alt\s*=\s*[\"']([^\"']*)", g["attrs"], re.I)):
            return [(s, e, alt[1])]
        return [(s, e, "\n" if name in BLOCK_TAGS and before not in ("", "\n") else "")]
    if k == "entity":
        plain = html.unescape(m.group()).replace("\xa0", " ")
        return [(s, e, plain if plain.isspace() or plain.isalnum() else keep(plain))]
    if k == "wiki_table":
        rows = [r for r in re.split(r"^\|-.*$", "\n".join(text[s:e].split("\n")[1:-1]), flags=re.M)]
        cells = [[c.split("|")[-1].strip() for line in r.strip().split("\n") if line.strip() and not line.startswith("|+") for c in re.split(r"\|\||!!", re.sub(r"^[|!]", "", line.strip()))] for r in rows]
        return [(s, e, "\n".join("\t".join(c) for c in cells if c))]
    if k == "wiki_heading":
        return [(s, e, "§" * len(g["f"]) + " " + inner)]
    if k == "wiki_link":
        target, _, label = inner.rpartition("|") if "|" in inner else ("", "", inner)
        return [(s, e, label or target)]
    if k == "template":
        name, *rest = inner.split("|")
        return [(s, e, "(" + ", ".join([name.strip(), *(r.strip() for r in rest)]) + ")")]
    if k in ("external", "link", "ref_link", "image"):
        return around()
    if k in ("wiki_indent", "quote"):
        return [(s, e, "")]
    if k == "foot":
        return [(s, e, f" (note {inner})")]
    if k == "foot_def":
        return [(s, e, f"Note {inner}: ")]
    if k == "heading":
        title = re.sub(r"[ \t]+#+$", "", inner)
        return [(s, m.start("in"), "§" * len(g["f"]) + " "), (m.start("in") + len(title), e, "")]
    if k == "setext":
        return [(s, s, "§ " if g["f"][0] == "=" else "§§ "), (m.end("in"), e, "")]
    if k == "table_row":
        cells = [c.strip() for c in inner.strip().strip("|").split("|")]
        return [(s, e, "\t".join(cells))]
    if k == "task":
        return [(s, e, "done" if inner.strip() else "open")]
    if k == "environment":
        return [(s, e, "")]
    if k == "escape":
        spacing = {",": " ", ";": " ", "!": "", "~": " ", " ": " ", "\\": "\n"}
        return [(s, e, spacing[inner] if inner in spacing else keep(inner))]
    if k == "command":
        arg, at = _argument(m)
        name, tie = g["name"], " " if g["tie"] else ""
        if name == "label":
            return [(s, e, "")]
        if name == "item":
            return [(s, e, "- ")]
        if name in ("cite", "citep", "citet", "ref", "eqref", "autoref", "pageref"):
            return [(s, e, f"{tie}({name.rstrip('pt') if name.startswith('cite') else 'see'} {arg})")]
        if name == "footnote":
            return [(s, e, f" (note: {arg})")]
        depth = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "title": 1}.get(name)
        if depth and arg:
            return [(s, e, "§" * depth + " " + arg)]
        if name in ("textbf", "textit", "emph", "texttt", "textsc", "textrm", "underline", "caption", "url", "text") and arg:
            return [(s, at, tie), (at + len(arg), e, "")]
        if name == "href" and arg:
            return [(s, e, arg)]
        if name in ("hline", "toprule", "midrule", "bottomrule", "centering", "noindent", "maketitle", "tableofcontents"):
            return [(s, e, "")]
        return [(s, e, tie + (arg if g["arg"] else name))]
    return []


def _rewrite(text: str, a: int, b: int, todo: list[tuple[int, int, str]]) -> str:
    """``text[a:b]`` with the replacements made, of overlapping ones the first."""
    out, at = [], a
    for s, e, new in sorted(todo, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], new]
            at = e
    return "".join(out) + text[at:b]


def apply(text: str, chosen: list[Piece], vault: Vault | None = None) -> str:
    """The chosen pieces rewritten, each after those inside it. Of two that cross, the later waits for another turn."""
    own = vault or Vault()
    tops: list[tuple[Piece, list]] = []
    open_: list[tuple[Piece, list]] = []
    for p in sorted(chosen, key=lambda p: (p.start, -p.end)):
        while open_ and open_[-1][0].end <= p.start:
            open_.pop()
        if open_ and p.end > open_[-1][0].end:
            continue
        node = (p, [])
        (open_[-1][1] if open_ else tops).append(node)
        open_.append(node)

    def inside(nodes: list, a: int, b: int) -> str:
        return _rewrite(text, a, b, [(p.start, p.end, rewritten(p, kids)) for p, kids in nodes])

    def rewritten(p: Piece, kids: list) -> str:
        before = text[p.start - 1] if p.start else ""
        if kids:
            local = inside(kids, p.start, p.end)
            if m := _PATTERN[p.kind].fullmatch(local):
                return _rewrite(local, 0, len(local), edits(p.kind, m, local, before, own.put))
        return _rewrite(text, p.start, p.end, edits(p.kind, p.m, text, before, own.put))

    # Between <code> and </code> only tags and entities count; all else is code.
    waiting: dict[str, tuple[int, int]] = {}
    flat: list[tuple[Piece, list]] = []
    for node in tops:
        p = node[0]
        name = p.m["name"].lower() if p.kind == "tag" else ""
        if name in CODE_TAGS and not p.m["close"]:
            waiting[name] = (p.end, len(flat) + 1)
        flat.append(node)
        if name in waiting and p.m["close"]:
            a, n = waiting.pop(name)
            code = inside([x for x in flat[n:-1] if x[0].kind in ("tag", "entity")], a, p.start)
            flat[n - 1 :] = [flat[n - 1], (Piece("", a, p.start, p.m), [own.put(code)]), node]
    todo = [(p.start, p.end, kids[0] if p.kind == "" else rewritten(p, kids)) for p, kids in flat]
    result = _rewrite(text, 0, len(text), todo)
    if any(p.kind == "environment" and (p.m.group("in") or "").startswith(("tabular", "array")) for p in chosen):
        result = re.sub(r"[ \t]*&[ \t]*", "\t", re.sub(r"[ \t]*\\\\[ \t]*$", "", result, flags=re.M))
    result = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", result, flags=re.M)).strip("\n")
    return result if vault else own.bring(result)


_tree: Tree | None = None
_ANY = re.compile(r"[<\[{}\\*_#`=|~$&:>]|''|^-{3}", re.M)


def find_markup(text: str | None, tree: Tree | None = None) -> list[Piece]:
    """Pieces whose marginal says markup."""
    global _tree
    if not isinstance(text, str) or not _ANY.search(text):
        return []
    found, blocks = pieces(text)
    if not found:
        return []
    if tree is None:
        _tree = _tree or Tree.load()
        tree = _tree
    p = tree.probabilities(found, blocks)
    return [x for x, q in zip(found, p) if q > 0.5]


_MARKS = re.compile(r"[<>\[\]{}\\*_#`=|~$&:;'!-]")


def clean_text(text: str | None, tree: Tree | None = None) -> tuple[str | None, list[str]]:
    """The text without markup and the kinds of pieces rewritten; repeated while something nested comes to light."""
    kinds: list[str] = []
    chosen = find_markup(text, tree)
    if not chosen:
        return text, kinds
    vault = Vault()
    if Vault.USED.search(text):
        text = Vault.USED.sub(lambda m: vault.put(m.group()), text)
        chosen = find_markup(text, tree)
    while chosen:
        kinds += [p.kind for p in chosen]
        new = apply(text, chosen, vault)
        if len(_MARKS.findall(new)) >= len(_MARKS.findall(text)):
            text = new
            break
        text, chosen = new, find_markup(new, tree)
    return vault.bring(text), kinds


CLEAN = "struct<content:string,content_kinds:array<string>,heading_path:array<string>,heading_kinds:array<string>>"


def clean_markup(df: DataFrame, content: str = "content", heading_path: str = "heading_path") -> DataFrame:
    """``df`` and a struct ``clean``: content, heading_path as plain text, and the kinds of markup found in each.

    Nulls stay null, null headings stay in their place, blank texts stay as they are; repeated rows come out alike. A column
    already named ``clean`` gets the new one an underscore in front.
    """

    @F.pandas_udf(CLEAN)
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str | None, list[str]]] = {}
        for texts, paths in batches:
            rows = []
            for t, p in zip(texts, paths):
                c, kinds = clean_text(t)
                heads, hk = None, []
                if p is not None:
                    heads = []
                    for h in p:
                        if h not in known:
                            if len(known) > 100_000:
                                known.clear()
                            known[h] = clean_text(h)
                        heads.append(known[h][0])
                        hk += known[h][1]
                rows.append({"content": c, "content_kinds": kinds, "heading_path": heads, "heading_kinds": hk})
            yield pd.DataFrame(rows, columns=["content", "content_kinds", "heading_path", "heading_kinds"])

    return df.withColumn(free_name(df.columns, "clean"), clean.asNondeterministic()(F.col(content), F.col(heading_path)))
