"""Documents to text and chunks: breadcrumbs, frontmatter, splitters, and converters of issues, pages and transcripts."""

from __future__ import annotations

import html as html_
import json
import re
from collections import deque
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.plans import carry_forward, cut, join_small, running_sum, spread, staged, with_fields

CHUNK, OVERLAP = 1000, 100
#: Frontmatter fields that become metadata.
METADATA_FIELDS = ["project", "gitBranch", "tags", "date", "category", "author", "issue_type", "status", "epic_link", "url"]


def breadcrumb(path: Column) -> Column:
    """Folders and file stem of a path; of more than four levels the first, "..." and the last two."""
    p = F.split(F.regexp_replace(path, r"\.[^./]+$", ""), "/")
    return F.array_join(F.when(F.size(p) > 4, F.concat(F.slice(p, 1, 1), F.array(F.lit("...")), F.slice(p, -2, 2))).otherwise(p), " > ")


def frontmatter_text(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def frontmatter(s: pd.Series) -> pd.Series:
    """Frontmatter as a map: `key: value`, quoted values unescaped, `- item` lines joined by commas. Only the head is read."""
    def one(t: str | None) -> dict[str, str]:
        m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---", (t or "")[:8192], re.S)
        out: dict[str, str] = {}
        key = None
        for line in m[1].splitlines() if m else []:
            item, pair = re.match(r"\s*-\s+(.*)", line), re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)", line)
            if item and key:
                v = item[1].strip().strip("\"'")
                out[key] = f"{out[key]}, {v}" if out[key] else v
            elif pair:
                key, v = pair[1], pair[2].strip()
                if len(v) > 1 and v[0] == v[-1] == '"':
                    v = v[1:-1].replace('\\"', '"').replace("\\\\", "\\")
                elif len(v) > 1 and v[0] == v[-1] == "'":
                    v = v[1:-1].replace("''", "'")
                out[key] = v
        return out

    return s.map(one)


def metadata_of(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: k.isin(*METADATA_FIELDS) & (v != ""))


def clean_body(text: Column) -> Column:
    """Text without fenced code and images; storage links become [file]."""
    t = F.regexp_replace(text, r"(?s)```.*?```", "")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", "")
    return F.regexp_replace(t, r"https?://\S*(?:amazonaws\.com|\.s3\.)\S*", "[file]")


def canonical_url(fields: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(fields["url"], F.lit("")), F.concat(F.lit("file://"), path))


def recursive_split(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size` characters: cut at the first separator that occurs, pieces that stay too long at the next;
    neighbours are joined up to the size, and each piece starts with up to `overlap` characters of whole parts of the last."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else text.split(sep)
    out: list[str] = []
    window: deque[str] = deque()
    held = 0  # characters of the window with its separators

    def flush() -> None:
        t = sep.join(window).strip()
        if t:
            out.append(t)

    for p in filter(None, parts) if sep else parts:
        if len(p) > size:
            flush()
            window.clear()
            held = 0
            out += recursive_split(p, size, overlap, finer) if finer else [p]
            continue
        if window and held + len(sep) + len(p) > size:
            flush()
            while window and (held > overlap or held + len(sep) + len(p) > size):
                held -= len(window.popleft()) + (len(sep) if window else 0)
        held += len(p) + (len(sep) if window else 0)
        window.append(p)
    flush()
    return out


def heading_sections(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[dict]:
    """Chunks by headings of level 1 to 3: {heading, text}; text before the first has none, empty sections are dropped, long
    ones split on."""
    marks = list(re.finditer(r"^#{1,3}[ \t]+(\S.*)$", text, re.M))
    if not marks:
        return [{"heading": None, "text": t} for t in recursive_split(text, size, overlap)]
    spans = [(None, 0, marks[0].start())] + [(re.sub(r"\s+#+\s*$", "", m[1].strip()), m.end(), n.start() if n else len(text)) for m, n in zip(marks, [*marks[1:], None])]
    out = []
    for heading, a, b in spans:
        body = text[a:b].strip()
        out += [{"heading": heading, "text": t} for t in ([body] if len(body) <= size else recursive_split(body, size, overlap)) if t]
    return out


def exchange_groups(turns: list[tuple[str, str]], target: int = 2500, least: int = 400) -> list[dict]:
    """Groups of exchanges (a user's turn and the answers to it) up to `target` characters, each starting with the last
    exchange of the one before; groups under `least` characters are dropped, but for the first."""
    exchanges: list[list[str]] = []
    for role, t in turns:
        if role == "user":
            exchanges.append([f"**User:** {t}"])
        elif exchanges:
            t = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?ms)^<details>.*?</details>|^> \*\*(?:Tool|Used)[^\n]*$", "", t)).strip()
            exchanges[-1].append(t)
    texts = [e[0] + (f"\n\n**Assistant:** {answer}" if (answer := "\n\n".join(x for x in e[1:] if x)) else "") for e in exchanges]
    out: list[dict] = []
    i = 0
    while i < len(texts):
        j, n = i + 1, len(texts[i])
        while j < len(texts) and n + len(texts[j]) <= target:
            n += len(texts[j])
            j += 1
        t = "\n\n---\n\n".join(texts[i:j])
        if len(t) >= least or not out:
            out.append({"heading": f"Turn {i + 1}" if j == i + 1 else f"Turns {i + 1}-{j}", "text": t})
        i = j - 1 if j - i > 1 and j < len(texts) else j
    return out


def session_chunks(text: str, target: int = 2500, least: int = 400) -> list[dict]:
    """The groups of a session transcript with `## User` and `## Assistant` headings."""
    marks = list(re.finditer(r"^## (User|Assistant)\b.*$", text, re.M))
    turns = [(m[1].lower(), text[m.end() : n.start() if n else len(text)].strip()) for m, n in zip(marks, [*marks[1:], None])]
    return exchange_groups([(r, t) for r, t in turns if t], target, least)


def chunk_documents(df: DataFrame, id: str, text: str, splitter: Callable[[str], list[dict]] = heading_sections) -> DataFrame:
    """Chunks of each document: id, chunk_number (from 0), heading, chunk. Null and empty texts have no chunk."""
    base = spread(df.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "c": [splitter(t) if t else [] for t in b["_text"]]})

    out = base.mapInPandas(run, with_fields(base.select("_id").schema, "c array<struct<heading:string,text:string>>"))
    return out.select(F.col("_id").alias(id), F.posexplode("c").alias("chunk_number", "x")).select(id, "chunk_number", "x.heading", F.col("x.text").alias("chunk"))


def with_fallback_chunk(chunks: DataFrame, documents: DataFrame, id: str = "doc_id", crumb: str = "breadcrumb") -> DataFrame:
    """Chunks, and for each document (id, breadcrumb) without any one chunk that holds its breadcrumb."""
    none = documents.join(chunks.select(id).distinct(), id, "left_anti")
    return chunks.unionByName(none.select(id, F.lit(0).alias("chunk_number"), F.lit(None).cast("string").alias("heading"), F.col(crumb).alias("chunk")))


def indexed_text(crumb: Column, tags: Column, epic: Column, heading: Column, body: Column) -> Column:
    """What is indexed of a chunk: breadcrumb, tags, epic and heading lines, then its body."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", F.nullif(crumb, F.lit("")), line("tags: ", tags), line("epic: ", epic), line("## ", heading), F.nullif(body, F.lit("")))


def _tree_text(node: object) -> str:
    if isinstance(node, list):
        return "".join(map(_tree_text, node))
    if not isinstance(node, dict):
        return ""
    kind = node.get("type")
    if kind == "text":
        return node.get("text") or ""
    if kind == "hardBreak":
        return "\n"
    if kind in ("mention", "emoji", "status", "inlineCard"):
        a = node.get("attrs") or {}
        return str(a.get("text") or a.get("shortName") or a.get("url") or "")
    inner = _tree_text(node.get("content") or [])
    return inner + "\n" if kind in ("paragraph", "heading", "listItem", "codeBlock", "blockquote", "tableRow", "rule", "panel") and not inner.endswith("\n") else inner


@F.pandas_udf(T.StringType())
def rich_document_text(s: pd.Series) -> pd.Series:
    """Text of a rich document tree in JSON (`type`, `text`, `content`): blocks end lines. Plain or broken JSON stays as it is."""
    def one(t: str | None) -> str | None:
        try:
            return _tree_text(json.loads(t)).strip() if t and t.lstrip().startswith("{") else t
        except ValueError:
            return t

    return s.map(one)


class _Markdown(HTMLParser):
    """Page storage to Markdown: headings, lists, tables, code and inline marks; macros and scripts are dropped."""

    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "s": "~~", "del": "~~"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.rows: list[list[str]] | None = None
        self.skip = 0
        self.pre = False
        self.links: list[str] = []

    def put(self, t: str) -> None:
        if self.rows is not None and self.rows and self.rows[-1]:
            self.rows[-1][-1] += t
        else:
            self.out.append(t)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "head") or tag.startswith("ac:") and tag not in ("ac:link", "ac:emoticon", "ac:rich-text-body", "ac:plain-text-body", "ac:structured-macro"):
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div"):
            self.put(" " if self.rows is not None else "\n\n")
        elif tag == "br":
            self.put(" " if self.rows is not None else "\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            depth = max(len(self.lists), 1)
            if self.lists:
                self.lists[-1][1] += 1
            self.put("\n" + "  " * (depth - 1) + (f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "))
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None and self.rows:
            self.rows[-1].append("")
        elif tag == "pre":
            self.pre = True
            self.put("\n\n```\n")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.put("[")
        elif tag == "ac:emoticon" or tag == "img":
            self.put("✓" if "tick" in f"{a.get('ac:name')}{a.get('alt')}" else "")
        elif tag in self.MARKS and not self.pre:
            self.put(self.MARKS[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head") or tag.startswith("ac:") and tag not in ("ac:link", "ac:emoticon", "ac:rich-text-body", "ac:plain-text-body", "ac:structured-macro"):
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            wide = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(c.strip().replace("|", "\\|") for c in [*r, *[""] * (wide - len(r))]) + " |" for r in rows]
            if lines:
                self.put("\n\n" + "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]) + "\n\n")
        elif tag == "pre":
            self.pre = False
            self.put("\n```\n\n")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.put(f"]({href})" if href else "]")
        elif tag in self.MARKS and not self.pre:
            self.put(self.MARKS[tag])

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))


def html_markdown(t: str) -> str:
    p = _Markdown()
    p.feed(t)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(p.out))).strip()


@F.pandas_udf(T.StringType())
def page_markdown(s: pd.Series) -> pd.Series:
    """Page storage (HTML) as Markdown."""
    return s.map(lambda t: html_markdown(t) if t else t)


@F.pandas_udf(T.StringType())
def html_excerpt(s: pd.Series) -> pd.Series:
    """The text of a page without scripts, styles and tags, entities resolved, blanks collapsed."""
    drop = re.compile(r"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]+>", re.S | re.I)
    return s.map(lambda t: re.sub(r"\s+", " ", html_.unescape(drop.sub(" ", t))).strip() if t else t)


def html_title(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def inject_tags(text: Column, tags: Column) -> Column:
    """The text with a `tags:` line in its frontmatter, put in or replaced."""
    line = F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]"))
    has = text.rlike(r"(?s)\A---[ \t]*\n.*?\n---")
    tagged = frontmatter_text(text).rlike(r"(?m)^tags:")
    quoted = F.regexp_replace(line, r"([\\$])", r"\\$1")
    body = F.concat(F.lit("---\n"), F.when(tagged, F.regexp_replace(frontmatter_text(text), F.lit(r"(?m)^tags:.*$"), quoted)).otherwise(F.concat(frontmatter_text(text), F.lit("\n"), line)), F.lit("\n---\n"), strip_frontmatter(text))
    return F.when(has, body).otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n"), text))


def rich_text_markdown(parts: list) -> str:
    """Marks of a block's text parts: bold, italic, code, strike, links."""
    out = []
    for p in parts or []:
        t, a = p.get("plain_text") or "", p.get("annotations") or {}
        if not t.strip():
            out.append(t)
            continue
        for key, mark in (("code", "`"), ("bold", "**"), ("italic", "*"), ("strikethrough", "~~")):
            if a.get(key):
                t = f"{mark}{t}{mark}"
        out.append(f"[{t}]({p['href']})" if p.get("href") else t)
    return "".join(out)


def block_markdown(kind: str, data: str | None, number: int = 1) -> str:
    """One page block as Markdown; unreadable data gives an empty line."""
    try:
        d = json.loads(data) if data else {}
    except ValueError:
        return ""
    t = rich_text_markdown(d.get("rich_text"))
    caption = rich_text_markdown(d.get("caption"))
    url = d.get("url") or (d.get("external") or d.get("file") or {}).get("url") or ""
    if m := re.fullmatch(r"heading_([1-3])", kind):
        return "#" * int(m[1]) + f" {t}"
    forms: dict[str, Callable[[], str]] = {
        "bulleted_list_item": lambda: f"- {t}", "toggle": lambda: f"- {t}", "numbered_list_item": lambda: f"{number}. {t}", "to_do": lambda: f"- [{'x' if d.get('checked') else ' '}] {t}",
        "quote": lambda: "> " + t.replace("\n", "\n> "), "callout": lambda: f"> {((d.get('icon') or {}).get('emoji') or '').strip()} {t}".replace(">  ", "> "), "divider": lambda: "---",
        "code": lambda: f"```{d.get('language') or ''}\n{''.join(p.get('plain_text') or '' for p in d.get('rich_text') or [])}\n```", "equation": lambda: f"$${d.get('expression') or ''}$$",
        "image": lambda: f"![{caption}]({url})", "bookmark": lambda: f"[{caption or url}]({url})", "embed": lambda: f"[{caption or url}]({url})", "video": lambda: f"[{caption or url}]({url})", "file": lambda: f"[{caption or url}]({url})", "pdf": lambda: f"[{caption or url}]({url})", "link_preview": lambda: f"[{url}]({url})",
        "table_row": lambda: "| " + " | ".join(rich_text_markdown(c).replace("|", "\\|") for c in d.get("cells") or []) + " |", "child_page": lambda: f"**{d.get('title') or ''}**", "child_database": lambda: f"**{d.get('title') or ''}**",
    }
    return forms[kind]() if kind in forms else t


def pages_from_blocks(blocks: DataFrame) -> DataFrame:
    """Pages of blocks (page_id, block_id, parent_id, pos, block_type, data, depth): page_id, blocks, markdown.

    A block delivered again counts once, as it came last (received_at). Runs of numbered items count from 1 within their
    parent; items are indented by depth. A page's blocks are joined in order of position.
    """
    one = blocks.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "block_id").orderBy(F.desc("received_at"), F.desc("ingest_id")))).filter("_n = 1")
    siblings = Window.partitionBy("page_id", "parent_id").orderBy("pos", "block_id")
    starts = (F.col("block_type") != F.coalesce(F.lag("block_type").over(siblings), F.lit(""))).cast("int")
    one = one.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(siblings))
    one = one.withColumn("_number", F.row_number().over(Window.partitionBy("page_id", "parent_id", "_run").orderBy("pos", "block_id")))

    @F.pandas_udf(T.StringType())
    def render(kind: pd.Series, data: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([block_markdown(k or "", d, int(n)) for k, d, n in zip(kind, data, number)])

    lines = one.select("page_id", "pos", "block_id", F.concat(F.repeat(F.lit("  "), F.when(F.col("block_type").rlike("list_item|to_do|toggle"), F.coalesce("depth", F.lit(0))).otherwise(0)), render("block_type", "data", "_number")).alias("line"))
    return lines.groupBy("page_id").agg(F.count("*").alias("blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block_id", "line"))), lambda x: x["line"]), "\n\n").alias("markdown"))


def issue_text(key: Column, summary: Column, description: Column, comments: Column) -> Column:
    return F.concat_ws("\n\n", F.concat_ws(" : ", key, summary), F.nullif(description, F.lit("")), F.array_join(comments, "\n\n"))


def issue_markdown(issues: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Issues as Markdown with frontmatter; a field that is missing now keeps the value of the existing file.
    issues, existing: issue_key, title, status, priority, assignee, description."""
    fields = ["title", "status", "priority", "assignee", "description"]
    j = issues
    if existing is not None:
        j = issues.join(existing.select("issue_key", *[F.col(c).alias(f"_{c}") for c in fields]), "issue_key", "left").select("issue_key", *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) for c in fields])
    head = F.concat_ws("\n", F.concat(F.lit("issue_key: "), "issue_key"), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c}: "'), F.regexp_replace(c, '"', r'\\"'), F.lit('"'))) for c in fields[:-1]])
    return j.select("issue_key", F.concat(F.lit("---\n"), head, F.lit("\n---\n\n# "), "issue_key", F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("description", F.lit(""))).alias("markdown"))


def transcript_lines(df: DataFrame, id: str, text: str) -> DataFrame:
    """Lines of timed transcripts: id, pos, seconds (of a leading `[MM:SS]` or `H:MM:SS`, else null), line."""
    from marlstone.functions.text import clock_seconds

    lines = df.select(F.col(id), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "raw")).filter(F.trim("raw") != "")
    mark = r"^\s*[\[(]?(\d{1,2}:\d{2}(?::\d{2})?)[\])]?\s*"
    return lines.select(id, "pos", clock_seconds(F.regexp_extract("raw", mark, 1)).alias("seconds"), F.trim(F.regexp_replace("raw", mark, "")).alias("line"))


def assign_chapters(lines: DataFrame, chapters: DataFrame, id: str) -> DataFrame:
    """As-of join: each line with the last chapter that starts at or before it. chapters: id, start, title. Lines before the
    first chapter have none. Both sides are sorted together; the last chapter seen is carried on, so nothing is multiplied."""
    both = lines.select(id, F.col("seconds").alias("_t"), F.lit(1).alias("_k"), F.struct(*[F.col(c) for c in lines.columns if c != id]).alias("_l"), F.lit(None).cast("string").alias("_c")).unionByName(
        chapters.select(id, F.col("start").alias("_t"), F.lit(0).alias("_k"), F.lit(None).alias("_l"), F.col("title").alias("_c")))
    return carry_forward(both, [id], ["_t", "_k"], "_c", "chapter").filter("_k = 1").select(id, "_l.*", "chapter")


def issue_queries(issues: DataFrame, terms: list[str]) -> DataFrame:
    """Search queries of an issue: its title, up to four known terms of its text in order of the alphabet, its epic."""
    words = F.slice(F.array_sort(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("description", F.lit(""))), F.lit(r"(\w+(?:-\w+)*)"), 1)), F.array(*[F.lit(t) for t in terms]))), 1, 4)
    return issues.select("issue_key", F.filter(F.array(F.nullif(F.col("title"), F.lit("")), F.nullif(F.array_join(words, " "), F.lit("")), F.nullif(F.col("epic_link"), F.lit(""))), lambda x: x.isNotNull()).alias("queries"))


PREFIX_LEAST = 80


def echo_prefix(title: Column, chunk: Column) -> Column:
    """A deterministic stand-in for a generator of contextual prefixes."""
    return F.format_string("Context: %s (%d characters).", F.coalesce(title, F.lit("untitled")), F.length(chunk))


#: Generators of contextual prefixes by name: functions of a title and a chunk. A model's is registered like these.
PREFIX_BACKENDS: dict[str, Callable[[Column, Column], Column]] = {"echo": echo_prefix, "none": lambda title, chunk: F.lit(None).cast("string")}


def register_backend(name: str, backend: Callable[[Column, Column], Column]) -> None:
    PREFIX_BACKENDS[name] = backend


def prefix_backend(spec: str) -> Callable[[Column, Column], Column]:
    """The generator that a spec names, as `name` or `name:model`; an unknown one is an error that lists the known."""
    name = spec.split(":", 1)[0]
    if name not in PREFIX_BACKENDS:
        raise ValueError(f"unknown prefix backend {name!r}, known: {', '.join(sorted(PREFIX_BACKENDS))}")
    return PREFIX_BACKENDS[name]


def generate_prefixes(chunks: DataFrame, spec: str) -> DataFrame:
    """Prefixes for the chunks that miss one (doc_id, chunk_hash, title, chunk), as rows of the cache: doc_id, chunk_hash, model,
    prefix. Empty prefixes aren't cached."""
    rows = chunks.select("doc_id", "chunk_hash", F.lit(spec).alias("model"), prefix_backend(spec)(F.col("title"), F.col("chunk")).alias("prefix"))
    return rows.filter("coalesce(trim(prefix), '') <> ''")


def property_text(prop: dict) -> str:
    """The value of one page property as text, by its type; unknown types give an empty text."""
    kind = prop.get("type") or ""
    v = prop.get(kind)
    if v is None:
        return ""
    plain = lambda parts: "".join(p.get("plain_text") or "" for p in parts or [])
    span = lambda d: " - ".join(x for x in (d.get("start"), d.get("end")) if x)
    forms: dict[str, Callable[[], str]] = {
        "title": lambda: plain(v), "rich_text": lambda: plain(v), "number": lambda: f"{v:g}" if isinstance(v, float) else str(v), "select": lambda: v.get("name") or "", "status": lambda: v.get("name") or "",
        "multi_select": lambda: ", ".join(x.get("name") or "" for x in v), "date": lambda: span(v), "people": lambda: ", ".join(x.get("name") or x.get("id") or "" for x in v), "files": lambda: ", ".join(x.get("name") or "" for x in v),
        "checkbox": lambda: "yes" if v else "no", "url": lambda: v, "email": lambda: v, "phone_number": lambda: v, "created_time": lambda: v, "last_edited_time": lambda: v, "created_by": lambda: v.get("name") or v.get("id") or "", "last_edited_by": lambda: v.get("name") or v.get("id") or "",
        "formula": lambda: property_text(v) if v.get("type") != "boolean" else ("yes" if v.get("boolean") else "no"), "string": lambda: v, "relation": lambda: ", ".join(x.get("id") or "" for x in v), "unique_id": lambda: "-".join(str(x) for x in (v.get("prefix"), v.get("number")) if x is not None),
        "rollup": lambda: ", ".join(filter(None, map(property_text, v.get("array") or []))) if v.get("type") == "array" else property_text(v), "verification": lambda: v.get("state") or "", "button": lambda: "", "boolean": lambda: "yes" if v else "no",
    }
    return forms[kind]() if kind in forms else ""


@F.pandas_udf(T.StringType())
def page_properties(s: pd.Series) -> pd.Series:
    """Page properties (JSON: name to property) as `**Name:** value` lines; the title and empty values are left out."""
    def one(t: str | None) -> str | None:
        try:
            d = json.loads(t) if t else {}
        except ValueError:
            return None
        lines = [(n, property_text(p)) for n, p in d.items() if isinstance(p, dict) and p.get("type") != "title"]
        return "\n".join(f"**{n}:** {v}" for n, v in lines if v)

    return s.map(one)


def page_path(crumbs: Column, title: Column) -> Column:
    """A page's file path: its ancestors' names and its title, safe for file systems."""
    from marlstone.functions.text import safe_filename

    return F.concat_ws("/", F.array_join(F.transform(crumbs, lambda c: safe_filename(c, 100)), "/"), F.concat(safe_filename(title, 100), F.lit(".md")))


def chapters_of(df: DataFrame, id: str, text: str) -> DataFrame:
    """Chapters that a description lists (`MM:SS title` lines): id, start, title; of one time the first."""
    from marlstone.functions.text import clock_seconds

    mark = r"^\s*[-*(\[]*\s*(\d{1,2}:\d{2}(?::\d{2})?)[)\]]?\s*[-–—:|]*\s*(\S.*)$"
    lines = df.select(F.col(id), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line")).filter(F.col("line").rlike(mark))
    c = lines.select(id, "pos", clock_seconds(F.regexp_extract("line", mark, 1)).alias("start"), F.trim(F.regexp_extract("line", mark, 2)).alias("title")).filter("start is not null")
    return c.groupBy(id, "start").agg(F.min_by("title", "pos").alias("title"))


def description_summary(text: Column) -> Column:
    """The first lines of a video description, up to a promotion, tags, a disclaimer, an address or a chapter."""
    stop = r"(?i)^\s*(?:#\w|https?://|subscribe\b|follow (?:me|us)\b|sponsor|disclaimer|affiliate|join\b.*(?:patreon|discord)|chapters?:?\s*$|timestamps?:?\s*$|[-*(\[]*\d{1,2}:\d{2})"
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    first = F.aggregate(lines, F.struct(F.lit(False).alias("end"), F.array().cast("array<string>").alias("l")), lambda a, x: F.struct((a["end"] | x.rlike(stop)).alias("end"), F.when(a["end"] | x.rlike(stop) | (F.trim(x) == ""), a["l"]).otherwise(F.concat(a["l"], F.array(F.trim(x)))).alias("l")))
    return F.array_join(first["l"], " ")


def transcript_markdown(lines: DataFrame, id: str) -> DataFrame:
    """Transcripts as Markdown: id, markdown. lines: id, pos, line, chapter; a heading where the chapter changes, the lines of a
    chapter as one paragraph."""
    w = Window.partitionBy(id).orderBy("pos")
    new = (~F.col("chapter").eqNullSafe(F.lag("chapter").over(w))).cast("int")
    part = lines.withColumn("_c", new).withColumn("_part", F.sum("_c").over(w))
    para = part.groupBy(id, "_part").agg(F.first("chapter").alias("chapter"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("t"))
    block = F.concat(F.coalesce(F.concat(F.lit("## "), "chapter", F.lit("\n\n")), F.lit("")), "t")
    return para.groupBy(id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("markdown"))


def tool_summary(uses: Column) -> Column:
    """Tool uses (array<struct<name, input>>) in one line each, by kind: the file, command, pattern or address they name."""
    of = lambda u, k: F.nullif(F.get_json_object(u["input"], f"$.{k}"), F.lit(""))
    return F.transform(uses, lambda u: F.concat_ws(": ", u["name"], F.substring(F.coalesce(of(u, "file_path"), of(u, "command"), of(u, "pattern"), of(u, "url"), of(u, "query"), of(u, "description")), 1, 120)))


def inject_html_tags(page: Column, tags: Column) -> Column:
    """A page with its keywords in a meta element: replaced, or put in after the charset, the head, or at the start."""
    plain = F.concat(F.lit('<meta name="keywords" content="'), F.array_join(tags, ", "), F.lit('">'))
    meta = F.regexp_replace(plain, r"([\\$])", r"\\$1")  # as a replacement
    old, charset, head = r"(?i)<meta\s+name=[\"']keywords[\"'][^>]*>", r"(?i)(<meta\s+charset[^>]*>)", r"(?i)(<head[^>]*>)"
    after = lambda p: F.regexp_replace(page, F.lit(p), F.concat(F.lit("$1\n"), meta))
    return F.when(page.rlike(old), F.regexp_replace(page, F.lit(old), meta)).when(page.rlike(charset), after(charset)).when(page.rlike(head), after(head)).otherwise(F.concat(plain, F.lit("\n"), page))


def category_and_summary(answer: Column) -> Column:
    """A model's answer with `CATEGORY:` and `SUMMARY:` lines as a struct."""
    return F.struct(F.lower(F.nullif(F.trim(F.regexp_extract(answer, r"(?im)^\s*CATEGORY:\s*(.+)$", 1)), F.lit(""))).alias("category"), F.nullif(F.trim(F.regexp_extract(answer, r"(?is)\bSUMMARY:\s*(.+)$", 1)), F.lit("")).alias("summary"))


# The characters of a phase's detail and of an error, and the bytes of a record.
MOST_DETAIL, MOST_RECORD = 2048, 64 * 1024


def guarded_records(records: DataFrame, detail: int = MOST_DETAIL, most: int = MOST_RECORD) -> DataFrame:
    """Records as JSON lines for a log, with a column `record`; a record is never dropped for its size.

    A phase's `detail` (phases array<struct<..., detail string>>, where there is one) over the limit becomes null and the phase
    says detailTruncated; the `error` of a record that is still too long is cut.
    """
    r = records
    kind = dict(r.dtypes).get("phases", "")
    if "detail:" in kind:
        long = lambda p: F.coalesce(F.length(p["detail"]) > detail, F.lit(False))
        r = r.withColumn("phases", F.transform("phases", lambda p: p.withField("detailTruncated", F.when(long(p), True)).withField("detail", F.when(~long(p), p["detail"]))))
    whole = F.struct(*[F.col(c) for c in r.columns])
    line = F.to_json(whole)
    if "error" in r.columns:
        cut = F.to_json(F.struct(*[F.substring("error", 1, detail).alias(c) if c == "error" else F.col(c) for c in r.columns]))
        line = F.when(F.octet_length(line) > most, cut).otherwise(line)
    return r.withColumn("record", line)


#: Characters of an issue's comments that one task splits; longer issues are split in parts of this size.
PART_CHARS = 1_000_000


def issue_chunks(issues: DataFrame, comments: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Chunks of issues: issue_key, chunk_number, chunk. The first is `KEY : title`, the others split description and comments.
    issues: issue_key (unique), title, description; comments: issue_key, pos, body. Issues without either have their first chunk
    only. An issue with very many comments is split in parts of `part_chars` characters, cut between comments, so that no task
    holds all of it; the chunks are numbered on."""
    texts = issues.select("issue_key", F.lit(None).cast(dict(comments.dtypes)["pos"]).alias("pos"), F.lit(0).alias("_k"), F.col("description").alias("body")).unionByName(comments.select("issue_key", "pos", F.lit(1).alias("_k"), "body"))
    texts = texts.filter("coalesce(body, '') <> '' and issue_key is not null")
    texts = join_small(texts, issues.select("issue_key").distinct(), ["issue_key"], "left_semi")
    long = cut(texts.groupBy("issue_key").agg(F.sum(F.length("body") + 2).alias("_n")).filter(F.col("_n") > part_chars).select("issue_key"))

    def pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
        joined = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "pos", "body"))), lambda x: x["body"]), "\n\n").alias("_text"))
        body = chunk_documents(joined.select(F.struct(*keys).alias("_id"), "_text"), "_id", "_text", lambda x: [{"heading": None, "text": p} for p in recursive_split(x)])
        return body.select("_id.*", "chunk_number", "chunk")

    out = issues.select("issue_key", F.lit(0).alias("chunk_number"), F.concat_ws(" : ", "issue_key", "title").alias("chunk"))
    out = out.unionByName(pieces(join_small(texts, long, ["issue_key"], "left_anti"), ["issue_key"]).withColumn("chunk_number", F.col("chunk_number") + 1))
    if long.isEmpty():
        return out
    measured = running_sum(join_small(texts, long, ["issue_key"], "left_semi"), ["issue_key"], ["_k", "pos", "body"], F.length("body") + 2, "_end")
    body = staged(pieces(measured.withColumn("_part", F.floor((F.col("_end") - F.length("body") - 2) / part_chars)), ["issue_key", "_part"]))
    sizes = body.groupBy("issue_key", "_part").agg(F.count("*").alias("_n"))  # one row a part
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("issue_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = join_small(body, sizes.select("issue_key", "_part", before.alias("_before")), ["issue_key", "_part"], "inner")
    return out.unionByName(body.select("issue_key", (F.col("chunk_number") + F.col("_before") + 1).cast("int").alias("chunk_number"), "chunk"))


def page_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of stored pages (page_id, ancestors array, title, storage): the first is the path `A -> B -> title`, the others split
    the text of the page."""
    t = pages.select("page_id", F.array_join(F.concat(F.coalesce("ancestors", F.array().cast("array<string>")), F.array("title")), " -> ").alias("_head"), html_excerpt("storage").alias("_text"))
    body = chunk_documents(t, "page_id", "_text", lambda x: [{"heading": None, "text": p} for p in recursive_split(x)])
    head = t.select("page_id", F.lit(0).alias("chunk_number"), F.col("_head").alias("chunk"))
    return head.unionByName(body.select("page_id", (F.col("chunk_number") + 1).alias("chunk_number"), "chunk"))
