"""File sources: folders of documents, session logs, frontmatter folders, run logs, graph files."""

from __future__ import annotations

import fnmatch
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import convert

# Endings of files that hold no text.
BINARY_ENDINGS = (
    "DS_Store zip tar jar rar gz tgz 7z bz2 xz lz4 zst cab deb rpm pkg dmg iso img "
    "exe dll so dylib app msi bin run "
    "class pyc pyo o obj lib a bundle "
    "mp4 avi mkv mov wmv flv webm m4v 3gp mpg mpeg vob ogv "
    "mp3 wav flac aac ogg wma m4a opus aiff au ra "
    "ttf otf woff woff2 eot "
    "db sqlite sqlite3 mdb accdb "
    "vmdk vdi qcow2 vhd vhdx "
    "swf fla unity3d unitypackage blend max 3ds fbx dae stl ply "
    "etp"
).split()
#: Further endings without text that no reader here takes: images and files of tools.
OTHER_ENDINGS = "png jpg jpeg gif bmp ico svg webp tif tiff war dat lock map min.js min.css parquet avro orc pkl npy npz pt onnx safetensors pdb".split()
TEXT_ENDINGS = "json md markdown mdx txt".split()


def scan_files(spark: SparkSession, root: str, include: list[str] = [r".*"], exclude: list[str] = [], modified_after: str | None = None) -> DataFrame:
    """Files under a folder: path (relative), modified, length, content. A path must match one of `include` whole, must not end
    like a binary file, nor match one of `exclude`; `.git` folders are left out. Paths are tested before contents are read.
    Spark itself leaves out names that start with `_` or `.`."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    base = os.path.abspath(root) if "://" not in root else root.rstrip("/")
    rel = F.regexp_replace("path", r"^(?:\w+:)?/*" + base.strip("/").replace(".", r"\.") + "/", "")
    f = r.load(root).withColumn("path", rel).filter(~F.col("path").rlike(r"(^|/)\.git/"))
    wanted = F.lit(False)
    for p in include:
        wanted = wanted | F.col("path").rlike(f"^(?:{p})$")
    f = f.filter(wanted & ~F.lower("path").rlike(r"\.(?:" + "|".join(re.escape(e.lower()) for e in BINARY_ENDINGS + OTHER_ENDINGS) + ")$"))
    for p in exclude:
        f = f.filter(~F.col("path").rlike(p))
    return f.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def text_files(files: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Text of files that are read as UTF-8; a file that can't be decoded has an error and no text, or with `fail_fast` stops the
    read with an error that names it."""
    ok = F.expr("is_valid_utf8(cast(content as string))")
    known = F.lower("path").rlike(r"\.(?:" + "|".join(TEXT_ENDINGS) + ")$")
    error = F.when(~known, "unsupported").when(~ok, "not utf-8")
    text = F.when(known & ok, F.col("content").cast("string"))
    if fail_fast:
        text = F.when(known & ~ok, F.raise_error(F.concat(F.lit("not utf-8: "), "path"))).otherwise(text)
    return files.select("path", "modified", text.alias("text"), error.alias("error"))


def _word_pages(content: bytes) -> list[str]:
    """Pages of a word processor file (a zip with word/document.xml): paragraphs by line, a page ends at a break that the writer
    set or the layout left."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    pages: list[list[str]] = [[]]
    for p in root.iter(f"{w}p"):
        line = ""
        for x in p.iter():
            if x.tag == f"{w}lastRenderedPageBreak" or (x.tag == f"{w}br" and x.get(f"{w}type") == "page"):
                pages[-1].append(line)
                pages.append([])
                line = ""
            elif x.tag == f"{w}t":
                line += x.text or ""
            elif x.tag in (f"{w}tab", f"{w}br"):
                line += "\t" if x.tag == f"{w}tab" else "\n"
        pages[-1].append(line)
    return ["\n".join(p).strip() for p in pages]


def _pdf_pages(content: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF reader installed") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


PAGE_READERS = {"docx": _word_pages, "pdf": _pdf_pages}


def file_pages(files: DataFrame) -> DataFrame:
    """Pages of files that have pages: path, modified, page (from 1), text, error. Empty pages are left out; a file that can't be
    read has one row with its error. PDF files need pypdf."""
    base = files.filter(F.lower("path").rlike(r"\.(?:" + "|".join(PAGE_READERS) + ")$")).select("path", "modified", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, modified, content in zip(b["path"], b["modified"], b["content"]):
                try:
                    pages = PAGE_READERS[path.rsplit(".", 1)[1].lower()](bytes(content))
                    out += [(path, modified, i, t, None) for i, t in enumerate(pages, 1) if t]
                except Exception as e:  # any damage to a file is its own
                    out.append((path, modified, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["path", "modified", "page", "text", "error"]).astype({"page": "Int64"})

    return base.mapInPandas(run, "path string, modified timestamp, page int, text string, error string")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below a folder with size and time, without those of writes under way (names that start with `_` or `.`, or end in
    `.tmp`)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified")).filter(~F.col("path").rlike(r"\.tmp$"))


def read_stats(read: DataFrame) -> DataFrame:
    return read.agg(F.count("*").alias("files"), F.count("text").alias("read"), F.count("error").alias("failed"))


def document_ids(files: DataFrame) -> DataFrame:
    """All ids of a source, whatever its time window: the basis of pruning."""
    return files.select(F.col("path").alias("doc_id")).distinct()


def exclude_hits(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """How many paths each exclusion pattern matches: pattern, hits. A pattern without hits may be misspelled."""
    sums = paths.agg(*[F.sum(F.col("path").rlike(p).cast("int")).alias(str(i)) for i, p in enumerate(patterns)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.coalesce(F.col(str(i)), F.lit(0)).alias("hits")) for i, p in enumerate(patterns)])).alias("x")).select("x.*")


def documents_from_files(texts: DataFrame) -> DataFrame:
    """Documents of text files: id, url, modified_time, text (without frontmatter), metadata, breadcrumb, title."""
    t = texts.filter("text is not null").withColumn("_f", convert.frontmatter("text"))
    return t.select(F.col("path").alias("id"), convert.canonical_url(F.col("_f"), F.col("path")).alias("url"), F.col("modified").alias("modified_time"), convert.strip_frontmatter(F.col("text")).alias("text"), convert.metadata_of(F.col("_f")).alias("metadata"), convert.breadcrumb(F.col("path")).alias("breadcrumb"), tx.title_from_path(F.col("path")).alias("title"))


def existing_keys(texts: DataFrame, field: str = "issue_key") -> DataFrame:
    """Values of a frontmatter field in a folder's files."""
    return texts.select(F.regexp_extract(F.substring("text", 1, 8192), rf"(?m)^{field}:\s*\"?([^\"\n]+?)\"?\s*$", 1).alias("key")).filter("key <> ''").distinct()


def read_sessions(spark: SparkSession, path: str, project: str | None = None, modified_after: str | None = None, existing: DataFrame | None = None, with_tools: bool = False) -> DataFrame:
    """Session logs (JSON lines of type, message{role, content}, isMeta, isSidechain) as messages: session, pos, role, text.

    Side chains, meta lines, tool results and messages of plumbing only are dropped. project: only files in folders whose name
    holds it; modified_after: only files changed since; existing: sessions (session) that are left out. with_tools: an answer's
    tool uses are listed in it as `> **Tool:** name` lines, and its thinking as details.
    """
    schema = "type string, sessionId string, isMeta boolean, isSidechain boolean, timestamp string, message struct<role:string, content:string>"
    r = spark.read.schema(schema)
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    r = r.json(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("pos", F.monotonically_increasing_id())
    if project:
        r = r.filter(F.contains(F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1), F.lit(project)))
    parts = F.from_json("message.content", "array<struct<type:string, text:string, name:string, thinking:string>>")
    shown = F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]))
    if with_tools:
        shown = F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"] == "tool_use", F.concat(F.lit("> **Tool:** "), p["name"])).when(p["type"] == "thinking", F.concat(F.lit("<details>\n"), p["thinking"], F.lit("\n</details>"))))
    text = F.coalesce(F.when(F.col("message.content").startswith("["), F.array_join(F.filter(shown, lambda t: t.isNotNull()), "\n\n")), F.col("message.content"))
    m = r.filter("type in ('user', 'assistant') and not coalesce(isMeta, false) and not coalesce(isSidechain, false)").select(F.coalesce("sessionId", F.regexp_extract("_file", r"([^/]+)\.jsonl$", 1)).alias("session"), "pos", F.coalesce("message.role", "type").alias("role"), tx.clean_command_text(text).alias("text"))
    if existing is not None:
        m = m.join(existing.select("session").distinct(), "session", "left_anti")
    return m.filter("text <> ''")


def session_markdown(messages: DataFrame, least: int = 4) -> DataFrame:
    """Sessions of at least `least` messages as Markdown with turns."""
    turn = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.col("text"))
    g = messages.groupBy("session").agg(F.count("*").alias("messages"), F.array_sort(F.collect_list(F.struct("pos", turn.alias("t")))).alias("turns"))
    return g.filter(F.col("messages") >= least).select("session", "messages", F.array_join(F.transform("turns", lambda x: x["t"]), "\n\n").alias("markdown"))


def parse_run_log(lines: DataFrame) -> DataFrame:
    """Runs of a log (file, pos, line) with start, finish and FAILED marks: file, nth, started, finished, status. The n-th finish
    closes the n-th start."""
    at = F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1)
    what = F.when(F.col("line").rlike(r"(?i)\b(?:start(?:ing|ed)?|begin)\b"), "start").when(F.col("line").rlike(r"FAILED|(?i:\berror\b.*exit)"), "failed").when(F.col("line").rlike(r"(?i)\b(?:finished|completed?|done)\b"), "finish")
    m = lines.select("file", "pos", at.alias("at"), what.alias("what")).filter("what is not null")
    w = Window.partitionBy("file", F.col("what") == "start").orderBy("pos")
    m = m.withColumn("nth", F.row_number().over(w))
    s = m.filter("what = 'start'").select("file", "nth", F.col("at").alias("started"))
    f = m.filter("what <> 'start'").select("file", "nth", F.col("at").alias("finished"), F.when(F.col("what") == "failed", "failed").otherwise("succeeded").alias("status"))
    return s.join(f, ["file", "nth"], "left").select("file", "nth", "started", "finished", F.coalesce("status", F.lit("incomplete")).alias("status"))


def graph_files(folders: list[str], extra: list[str] = [], patterns: list[str] = ["*graph*.json"]) -> list[str]:
    """Graph files of folders in order of their names, then the extra ones, each once."""
    found = [os.path.join(d, f) for d in folders if os.path.isdir(d) for f in sorted(os.listdir(d)) if any(fnmatch.fnmatch(f, p) for p in patterns)]
    return list(dict.fromkeys([*found, *extra]))


def graph_paths(folders: list[str], extra: list[str] = [], variable: str = "GRAPH_PATHS") -> list[str]:
    """Graph files in order of precedence: those an environment variable names (parted by the system's path sign), else those of
    the folders and the extra ones; files that don't exist are left out."""
    named = [p for p in os.environ.get(variable, "").split(os.pathsep) if p]
    return [p for p in (named or graph_files(folders, extra)) if os.path.exists(p)]


def read_graphs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph files, with file_no for `merge_nodes` and `merge_edges`."""
    props = "map<string,string>"
    schema = f"nodes array<struct<id:string,type:string,label:string,properties:{props}>>, edges array<struct<source:string,target:string,type:string,properties:{props}>>"
    both = [spark.read.schema(schema).json(p, multiLine=True).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)]
    one = both[0]
    for b in both[1:]:
        one = one.unionByName(b)
    return one.select("file_no", F.inline("nodes")), one.select("file_no", F.inline("edges"))


def wiki_topics(texts: DataFrame) -> DataFrame:
    """Topics of a wiki folder's `entities/` and `concepts/` files: topic, kind, summary (the first line of the body)."""
    t = texts.filter(F.col("path").rlike(r"(^|/)(?:entities|concepts)/"))
    body = F.filter(F.split(convert.strip_frontmatter(F.col("text")), "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    return t.select(F.regexp_replace(tx.title_from_path(F.col("path")), r"\.md$", "").alias("topic"), F.regexp_extract("path", r"(entities|concepts)/", 1).alias("kind"), F.try_element_at(body, F.lit(1)).alias("summary"))


def read_schedules(paths: list[str]) -> list[dict]:
    """Schedules of launchd property lists: name, hour, minute, weekday, interval_s; a list per calendar entry. A few files of one
    machine, read on the driver; broken ones are left out."""
    import plistlib

    out = []
    for p in paths:
        try:
            with open(p, "rb") as f:
                d = plistlib.load(f)
        except (OSError, ValueError, plistlib.InvalidFileException):
            continue
        when = d.get("StartCalendarInterval")
        entries = when if isinstance(when, list) else [when] if when else []
        if d.get("StartInterval"):
            out.append({"name": d.get("Label"), "hour": None, "minute": None, "weekday": None, "interval_s": int(d["StartInterval"])})
        out += [{"name": d.get("Label"), "hour": e.get("Hour"), "minute": e.get("Minute", 0), "weekday": e.get("Weekday"), "interval_s": None} for e in entries]
    return out
