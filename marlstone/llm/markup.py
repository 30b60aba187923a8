"""Markup residue in texts: which kinds there are, and the text without them, its structure kept.

One scanner per kind, in an order that keeps them apart: code samples and formulas are set aside first, so nothing inside
them is read as markup; then HTML, LaTeX, wiki notation and Markdown are taken off, each into one canonical form:
"# " headings by level, "- " list items, " | " between cells, ``` around code blocks, $ or $$ around formulas.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans import spread, with_fields

#: Stands for one level of a heading taken from another notation, until all kinds are read.
LEVEL = "\ue002"
KINDS = ("html", "markdown", "wiki", "latex")
# Names of HTML elements.
TAGS = (
    "a abbr address article aside audio b big blockquote body br button caption center cite code col colgroup dd del details dfn dir div dl dt em embed figcaption figure "
    "font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta nav noscript object ol option "
    "p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video"
).split()
BLOCK = set("address article aside blockquote body center dd details div dl dt figure footer form header hr main nav ol p section table tbody thead tfoot tr ul pre br caption".split())
# LaTeX commands that stand without an argument.
SYMBOLS = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma "
    "Phi Psi Omega leq geq neq le ge ne approx equiv sim cdot times div pm mp infty partial nabla sum prod int oint lim sup inf max min log ln exp sin cos tan to rightarrow leftarrow "
    "Rightarrow Leftarrow in notin subset subseteq cup cap forall exists ldots cdots dots quad qquad item maketitle tableofcontents newpage noindent centering hline left right mathrm"
).split()

_TAG = re.compile(r"</?(?P<n>" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")(?:\s[^<>]*|/)?\s*/?>", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<!\[CDATA\[.*?\]\]>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_SAMPLES = [
    ("markdown", re.compile(r"^[ \t]*(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<c>.*?)(?:^[ \t]*(?P=f)[`~]*[ \t]*$|\Z)", re.S | re.M)),
    ("markdown", re.compile(r"```(?P<c>[^`]+)```", re.S)),
    ("wiki", re.compile(r"\{(?P<t>code|noformat)(?::[^}\n]*)?\}\n?(?P<c>.*?)(?:\{(?P=t)\}|\Z)", re.S)),
    ("wiki", re.compile(r"<(?P<t>nowiki|syntaxhighlight|source)\b[^>]*>(?P<c>.*?)</(?P=t)>", re.S | re.I)),
    ("html", re.compile(r"<(?P<t>pre|script|style)\b[^>]*>(?P<c>.*?)</(?P=t)\s*>", re.S | re.I)),
    ("html", re.compile(r"<(?P<t>code)\b[^>]*>(?P<c>.*?)</(?P=t)\s*>", re.S | re.I)),
    ("latex", re.compile(r"\\begin\{(?P<t>verbatim\*?|lstlisting|minted)\}(?:\[[^\]]*\])?(?:\{\w+\})?\n?(?P<c>.*?)(?:\\end\{(?P=t)\}|\Z)", re.S)),
    ("latex", re.compile(r"\\verb(?P<t>[|!+/@])(?P<c>[^\n]*?)(?P=t)")),
    ("wiki", re.compile(r"\{\{(?P<c>[^{}\n|]+)\}\}")),
    ("markdown", re.compile(r"(?<!`)(?P<t>`{1,2})(?!`)(?P<c>[^`\n]+)(?P=t)(?!`)")),
]
_SAMPLE = re.compile(r"```|~~~|\{code|\{noformat|\{\{|`|<(?:pre|code|script|style|nowiki|syntaxhighlight|source)\b|\\begin\{(?:verbatim|lstlisting|minted)|\\verb", re.I)
_MATH = re.compile(
    r"\$\$(?P<a>.+?)\$\$|\\\[(?P<b>.+?)\\\]|\\begin\{(?P<t>equation|align|gather|multline|eqnarray|displaymath|math)(?P<s>\*?)\}(?P<c>.*?)\\end\{(?P=t)(?P=s)\}"
    r"|\\\((?P<d>.+?)\\\)|(?<![\\$\w])\$(?P<e>(?=[^$\n]*[\\_^{}])[^$\n]{1,200}?[^\s$\\]|[A-Za-z]|[^$\n\d\s][^$\n]{0,60}=[^$\n]{0,60}[^\s$])\$(?![\w$])",
    re.S,
)
_LATEX = re.compile(r"(?<![\w\\:])\\(?:(?:" + "|".join(SYMBOLS) + r")(?![A-Za-z])|[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])*\{)|\\(?:begin|end)\{\w+\*?\}|\\[%&_#$]|(?<=\w)\\(?:cite|ref|label|footnote)\{|~\\[a-z]+\{")
_WIKI = [
    re.compile(r"^[ \t]*h(?P<l>[1-6])\.[ \t]+(?P<x>.*)$", re.M),
    re.compile(r"^[ \t]*bq\.[ \t]+(?P<x>.*)$", re.M),
    re.compile(r"^(?P<l>={2,6})[ \t]*(?P<x>[^=\n].*?)[ \t]*(?P=l)[ \t]*$", re.M),
    re.compile(r"\{(?:color|quote|panel|info|tip|note|warning|expand|anchor|toc|section|column)(?::[^}\n]*)?\}"),
    re.compile(r"^[ \t]*\|\|(?P<x>.*?)\|\|[ \t]*$", re.M),
    re.compile(r"\[\[(?:File|Image|Fil|Datei|Fichier|Archivo):[^\]]*\]\]", re.I),
    re.compile(r"\[\[(?:[^\]|\n]*\|)?(?P<x>[^\]|\n]+)\]\]"),
    re.compile(r"\[~(?P<x>[\w.@-]+)\]"),
    re.compile(r"\[(?P<x>[^\]|\[\n]+)\|(?:[a-z]+:[^\]\s]+|[#^][^\]\n]+|[\w-]+-\d+|/[^\]\s]*)(?:\|[^\]\n]*)?\]"),
    re.compile(r"\[(?:https?|ftp|mailto):[^\]\s]+(?:[ \t]+(?P<x>[^\]\n]+))?\](?!\()"),
    re.compile(r"(?<![\w!])!(?:https?://)?[\w./%-]+\.(?:png|jpe?g|gif|svg|bmp|webp)(?:\|[^!\n]*)?!(?!\w)", re.I),
    re.compile(r"(?P<l>'{2,5})(?P<x>[^'\n](?:[^\n]*?[^'\n])?)(?P=l)(?!')"),
    re.compile(r"(?<!\w)\?\?(?P<x>[^?\n]+)\?\?(?!\w)|(?<![\w^])\^(?P<y>[^\s^][^^\n]{0,30})\^(?!\w)|(?<![\w+])\+\+?(?P<z>[^\s+][^+\n]{0,60}[^\s+])\+(?!\w)"),
    re.compile(r"</?(?:ref|references|gallery|blockquote-wiki)\b[^>]*>"),
    re.compile(r"^[ \t]*\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[ \t]*$", re.M),
    re.compile(r"^----+[ \t]*$(?!\n)", re.M),
    re.compile(r"\{\{[^{}]*\}\}"),
]
_WIKI_ANY = re.compile(r"^[ \t]*(?:h[1-6]\.|bq\.)[ \t]|^==|\{(?:color|quote|panel|info|tip|note|warning|expand|anchor|toc|section|column)\b|\|\||\[\[|\[~|\[[^\]|\[\n]+\||\[(?:https?|ftp|mailto):|\.(?:png|jpe?g|gif|svg|bmp|webp)(?:\|[^!\n]*)?!|''|\?\?|^[ \t]*\{\||^\|[}-]|^----|\{\{|</?(?:ref|gallery|blockquote-wiki)|\^[^\s^][^^\n]*\^|\+\S[^+\n]*\+", re.M | re.I)
_MD = [
    re.compile(r"^[ \t]{0,3}(?P<l>#{1,6})[ \t]+(?P<x>\S.*?)[ \t]*#*[ \t]*$", re.M),
    re.compile(r"^(?P<x>[^\n]*\w[^\n]*)\n(?P<l>=|-)(?P=l){2,}[ \t]*$", re.M),
    re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?", re.M),
    re.compile(r"!\[(?P<x>[^\]\n]*)\]\((?:<[^>\n]*>|[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:[ \t]+\"[^\"\n]*\")?\)"),
    re.compile(r"\[(?P<x>[^\]\n]+)\]\((?:<[^>\n]*>|[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)"),
    re.compile(r"\[(?P<x>[^\]\n]+)\]\[[^\]\n]*\]|^[ \t]{0,3}\[[^\]\n]+\]:[ \t]+\S+.*$", re.M),
    re.compile(r"^(?P<i>[ \t]*)(?:[-*+]|\d+[.)])[ \t]+\[[ xX]\][ \t]+", re.M),
    re.compile(r"^[ \t]{0,3}(?:>[ \t]?)+(?=\S)", re.M),
    re.compile(r"(?<!\*)(?P<l>\*{2,3})(?=[^\s*])(?P<x>[^\n]*?[^\s*])(?P=l)(?!\*)"),
    re.compile(r"(?<![\w_])(?P<l>_{2,3})(?=[^\s_])(?P<x>[^\n]*?[^\s_])(?P=l)(?![\w_])"),
    re.compile(r"(?<!~)~~(?=[^\s~])(?P<x>[^\n]*?[^\s~])~~(?!~)"),
    re.compile(r"<(?P<x>https?://[^<>\s]+)>"),
]
_MD_ANY = re.compile(r"^[ \t]{0,3}#{1,6}[ \t]|\n[=-]{3,}[ \t]*$|\|?[ \t]*:?--+:?[ \t]*\||\]\(|\][\[:]|\[[ xX]\][ \t]|^[ \t]{0,3}>|\*\*|__|~~|<https?://", re.M)
_ANY = re.compile(r"[<&`{\[\\$|=#>~!?^+]|\*\*|__|''|^[ \t]*(?:h\d|bq)\.|^[-=]{3}", re.M)
_ROW = re.compile(r"^[ \t]*\|(?!\|)(?P<x>[^\n]*)\|[ \t]*$", re.M)


def convert(text: str) -> tuple[str, list[str]]:
    """The clean text, and the kinds of markup that were in it."""
    if not _ANY.search(text):
        return text, []
    found: set[str] = set()
    kept: list[str] = []

    def keep(rendered: str) -> str:
        kept.append(rendered)
        return f"\ue000{len(kept) - 1}\ue001"

    t = text.replace("\r\n", "\n").replace("\ue000", "").replace("\ue001", "").replace(LEVEL, "")
    if _SAMPLE.search(t):
        # the sample that starts first is taken first: what looks like another inside it belongs to it
        at, out = 0, []
        while True:
            first = None
            for kind, pattern in _SAMPLES:
                m = pattern.search(t, at)
                if m and (first is None or m.start() < first[1].start()):
                    first = (kind, m)
            if first is None:
                break
            kind, m = first
            found.add(kind)
            code = m["c"]
            if kind == "html" and m["t"].lower() in ("script", "style"):
                code = ""
            elif kind == "html":
                code = html.unescape(re.sub(r"</?code\b[^>]*>", "", code))
            block = "\n" in code.strip("\n") or m[0].count("\n") > 1 or (kind == "html" and m["t"].lower() == "pre")
            out += [t[at : m.start()], keep(f"```\n{code.strip(chr(10))}\n```" if block else code.strip("\n")) if code else ""]
            at = max(m.end(), m.start() + 1)
        t = "".join(out) + t[at:]
    if "$" in t or "\\" in t:
        def math(m: re.Match) -> str:
            found.add("latex")
            inner = next(m[g] for g in "abcde" if m[g] is not None).strip()
            return keep(f"${inner}$" if m["d"] is not None or m["e"] is not None else f"$${inner}$$")

        t = _MATH.sub(math, t)
    if "<" in t:
        t, n = _COMMENT.subn("", t)
        if n:
            found.add("html")
        t = _html(t, found)
    if "&" in t and _ENTITY.search(t):
        def entity(m: re.Match) -> str:
            u = html.unescape(m[0])
            if u != m[0]:
                found.add("html")
                return keep(u) if u in "<>&|*_`~$\\[]{}#" else u
            return m[0]

        t = _ENTITY.sub(entity, t)
    if "\\" in t and _LATEX.search(t):
        found.add("latex")
        t = _latex(t)
    if _WIKI_ANY.search(t):
        t = _wiki(t, found)
    if _MD_ANY.search(t):
        t = _markdown(t, found)
    t = _ROW.sub(lambda m: " | ".join(c.strip() for c in m["x"].split("|")), t) if "|" in t and found & {"wiki", "markdown"} else t
    if not found:
        return text, []
    t = t.replace(LEVEL, "#")
    for _ in range(3):  # samples may stand inside others
        if "\ue000" not in t:
            break
        t = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], t)
    t = re.sub(r"[ \t]+(?=\n)|[ \t]+\Z", "", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip("\n"), [k for k in KINDS if k in found]


def _html(t: str, found: set[str]) -> str:
    def tag(m: re.Match) -> str:
        found.add("html")
        n, closing = m["n"].lower(), m[0].startswith("</")
        if re.fullmatch("h[1-6]", n):
            return "\n" if closing else "\n" + LEVEL * int(n[1]) + " "
        if n == "li":
            return "" if closing else "\n- "
        if n in ("td", "th"):
            return "" if not closing else " | "
        if n == "img":
            alt = re.search(r"alt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", m[0], re.I)
            return next((g for g in alt.groups() if g), "").rstrip("/>") if alt else ""
        return "\n" if n in BLOCK else ""

    out = _TAG.sub(tag, t)
    return re.sub(r" \| (?=\n)", "", out) if out != t else t


def _latex(t: str) -> str:
    for level, name in enumerate(("chapter", "section", "subsection", "subsubsection", "paragraph"), 0):
        t = re.sub(rf"\\{name}\*?\{{([^{{}}\n]*)\}}", lambda m, n=max(level, 1): "\n" + LEVEL * n + " " + m[1] + "\n", t)
    t = re.sub(r"[ \t]*\\item(?:\[[^\]]*\])?[ \t]*", "- ", t)
    t = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?[ \t]*\n?", "", t)
    t = re.sub(r"~?\\(?:cite[a-z]*|ref|eqref|label|pageref|autoref|index|vspace|hspace|includegraphics|usepackage|documentclass)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}", "", t)
    for _ in range(4):  # from the innermost argument outwards
        new = re.sub(r"\\(?:href\{[^{}\n]*\})?(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])?)?\{([^{}\n]*)\}", r"\1", t)
        if new == t:
            break
        t = new
    t = re.sub(r"\\([%&_#${}])", r"\1", t)
    return re.sub(r"(?<![\w\\:])\\(?:" + "|".join(SYMBOLS) + r")(?![A-Za-z])[ \t]?", "", t).replace("~", " ") if "\\" in t else t


def _wiki(t: str, found: set[str]) -> str:
    def content(m: re.Match) -> str:
        found.add("wiki")
        d = m.groupdict()
        return next((d[g] for g in "xyz" if d.get(g) is not None), "")

    for i, p in enumerate(_WIKI):
        if i == 0:
            t = p.sub(lambda m: (found.add("wiki"), LEVEL * int(m["l"]) + " " + m["x"])[1], t)
        elif i == 2:
            t = p.sub(lambda m: (found.add("wiki"), LEVEL * (len(m["l"]) - 1) + " " + m["x"])[1], t)
        elif i == 4:
            t = p.sub(lambda m: (found.add("wiki"), " | ".join(c.strip() for c in m["x"].split("||")))[1], t)
        else:
            t = p.sub(content, t)
    return t


def _markdown(t: str, found: set[str]) -> str:
    for i, p in enumerate(_MD):
        if i == 0:
            t = p.sub(lambda m: (found.add("markdown"), m["l"] + " " + m["x"])[1], t)
        elif i == 1:
            t = p.sub(lambda m: (found.add("markdown"), ("# " if m["l"] == "=" else "## ") + m["x"])[1], t)
        elif i == 6:
            t = p.sub(lambda m: (found.add("markdown"), m["i"] + "- ")[1], t)
        else:
            t = p.sub(lambda m: (found.add("markdown"), m.groupdict().get("x") or "")[1], t)
    return t


#: Keys of a block whose strings aren't text.
NOT_TEXT = {"url", "href", "type", "language"}


def block_texts(data: str) -> tuple[list[str], bool] | None:
    """The texts in a block's data (the parts of one rich text joined, and each part), and whether there is an equation; None if it can't be read."""
    try:
        root = json.loads(data)
    except (ValueError, RecursionError):
        return None
    out: list[str] = []
    equation = False

    def walk(x: object) -> None:
        nonlocal equation
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            parts = [p["plain_text"] for p in x if isinstance(p, dict) and isinstance(p.get("plain_text"), str)]
            if len(parts) > 1:
                out.append("".join(parts))
            for v in x:
                walk(v)
        elif isinstance(x, dict):
            for k, v in x.items():
                if k == "expression" and isinstance(v, str) and v.strip():
                    equation = True
                if k not in NOT_TEXT:
                    walk(v)

    walk(root)
    return out, equation


def _block(data: str, block_type: str | None) -> tuple[str | None, list[str]]:
    got = block_texts(data)
    if got is None:
        return None, []
    texts, equation = got
    if block_type == "code":
        return "```\n" + "\n".join(texts) + "\n```" if texts else "", []
    kinds = {"latex"} if equation else set()
    for t in texts:
        kinds.update(convert(t)[1])
    root = json.loads(data)
    clean = convert(_visible(root))[0] if not equation else f"$${_visible(root).strip()}$$"
    return clean, [k for k in KINDS if k in kinds]


def _visible(x: object, key: str = "") -> str:
    """A block's text for reading: parts of one rich text joined, cells parted by bars, other strings by line."""
    if isinstance(x, str):
        return x
    if isinstance(x, list):
        if key == "cells":
            return " | ".join(_visible(c) for c in x)
        if any(isinstance(p, dict) and "plain_text" in p for p in x):
            return "".join(p.get("plain_text") or "" for p in x if isinstance(p, dict))
        return "\n".join(s for s in (_visible(v) for v in x) if s)
    if isinstance(x, dict):
        return "\n".join(s for s in (_visible(v, k) for k, v in x.items() if k not in NOT_TEXT and k not in ("annotations", "icon")) if s)
    return ""


def clean_markup(df: DataFrame, text: str, keep: list[str], block_type: str | None = None) -> DataFrame:
    """Texts without markup: `keep`, clean (the text) and kinds array<string> of html, markdown, wiki, latex.

    With `block_type`, `text` holds the JSON of page blocks: their strings are read, but for addresses, types and languages;
    blocks of type code are samples as a whole. Null texts and unreadable JSON give a null and no kinds, empty ones an empty
    text; rows stay one to one; other columns don't matter.
    """
    base = spread(df.select(F.struct(*keep).alias("_keep"), F.col(text).cast("string").alias("_text"), (F.col(block_type) if block_type else F.lit(None)).cast("string").alias("_type")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(None, []) if t is None else (_block(t, k) if block_type else convert(t)) for t, k in zip(b["_text"], b["_type"])]
            yield pd.DataFrame({"_keep": b["_keep"], "clean": [g[0] for g in got], "kinds": [g[1] for g in got]})

    return base.mapInPandas(run, with_fields(base.select("_keep").schema, "clean string, kinds array<string>")).select("_keep.*", "clean", "kinds")
