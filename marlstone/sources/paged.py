"""Paged sources: a Spark data source over any paged reader, with retries, fall-back to single rows and a read-through cache."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def retry(call: Callable, times: int = 3, delay: float = 1.0, factor: float = 1.0, skip: bool = False):
    """The result of `call`, tried again after a delay (growing by `factor`); with `skip`, None after the last failure."""
    for i in range(times):
        try:
            return call()
        except Exception:
            if i + 1 == times:
                if skip:
                    return None
                raise
            time.sleep(delay * factor**i)


def read_batches(read: Callable[[int, int], list], total: int, size: int, most_skipped: int = 3) -> Iterator:
    """Items read in batches; a batch that fails is read one by one, items that fail are skipped, but no more than
    `most_skipped` in a row."""
    skipped = 0
    for start in range(0, total, size):
        n = min(size, total - start)
        try:
            items = read(start, n)
            skipped = 0
            yield from items
        except Exception:
            for i in range(start, start + n):
                try:
                    items = read(i, 1)
                except Exception:
                    skipped += 1
                    if skipped > most_skipped:
                        raise
                    continue
                skipped = 0
                yield from items


def read_cursor(read: Callable[[str | None], tuple[list, str | None]]) -> Iterator:
    """Items of a source that names its next page."""
    cursor, first = None, True
    while first or cursor:
        items, cursor = read(cursor)
        first = False
        yield from items


def read_until(pages: Iterator[list[dict]], field: str, cutoff: str) -> Iterator[dict]:
    """Items of a source sorted by time, newest first, until one is older than the cutoff: no page after it is asked for."""
    for page in pages:
        for item in page:
            if item[field] < cutoff:
                return
            yield item


def page_query(user_query: str | None, kind: str = "page") -> str:
    return f"type={kind} AND ({user_query})" if user_query else f"type={kind}"


def updated_since(query: str, field: str, since: str | None) -> str:
    return f'({query}) AND {field} >= "{since}"' if since else query


def numbered(start: int, n: int) -> list[dict]:
    """A source for trials: items with their number."""
    return [{"id": i, "name": f"n{i}"} for i in range(start, start + n)]


class _Pages(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        total, size = int(self.options["total"]), int(self.options.get("size", "50"))
        per = max(size, -(-total // max(1, int(self.options.get("partitions", "8")))) // size * size or size)
        return [InputPartition((a, min(per, total - a))) for a in range(0, total, per)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, name = self.options["reader"].rsplit(".", 1)
        read = getattr(__import__(module, fromlist=[name]), name)
        start, n = partition.value
        size = int(self.options.get("size", "50"))
        names = self.schema.fieldNames()
        for item in read_batches(lambda s, k: retry(lambda: read(start + s, k), delay=0.1), n, size):
            yield tuple(item.get(c) for c in names)


class PagedSource(DataSource):
    """`spark.read.format("paged").schema(...).option("reader", "module.function").option("total", n)`: the function gives the
    items (dicts) of an offset and a count; each partition reads its own range of pages."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(schema, self.options)


def read_through(spark: SparkSession, folder: str, details: dict, read: Callable[[], DataFrame]) -> DataFrame:
    """A source's rows from the cache of its details, written at the first read; only a completed write counts."""
    key = hashlib.sha256(json.dumps(details, sort_keys=True).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{key}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        read().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# Readers over recorded or live responses --------------------------------------------------------------------------------------

# Rows of a page, and the depth to which blocks are read.
ISSUE_PAGE, WIKI_PAGE, BLOCK_PAGE, BLOCK_DEPTH = 500, 50, 100, 10
ISSUE_SCHEMA = "issue_key string, title string, status string, type string, priority string, assignee string, reporter string, labels array<string>, description string, created string, updated string, epic_link string, parent string, parent_type string, parent_summary string, comments array<struct<author:string,date:string,body:string>>"
PAGE_SCHEMA = "page_id string, title string, space string, modified string, url string, ancestors array<string>, storage string, comments array<string>"
BLOCK_SCHEMA = "page_id string, block_id string, parent_id string, pos int, block_type string, data string, depth int"


def read_pages(read: Callable[[int, int], dict], items: str = "issues", size: int = ISSUE_PAGE, most_skipped: int = 3) -> Iterator[dict]:
    """Items of a search that answers with its total (`total`, items, by offset and count); a page that comes short of what its
    total promises is an error, so that no part is taken for the whole."""
    first = read(0, size)
    total = int(first.get("total") or 0)
    yield from first[items]
    if len(first[items]) < min(size, total):
        raise ValueError(f"{len(first[items])} of {min(size, total)} items came")
    yield from read_batches(lambda start, n: read(start + size, n)[items], max(0, total - size), size, most_skipped)


def read_tokens(read: Callable[[str | None], dict], items: str = "issues") -> Iterator[dict]:
    """Items of a search that names its next page by a token (`nextPageToken`), until it says `isLast` or names none."""
    token = None
    while True:
        page = read(token)
        yield from page.get(items) or []
        token = page.get("nextPageToken")
        if page.get("isLast") or not token:
            return


def issue_query(query: str | None, updated_from: str | None = None) -> str:
    """The query of an issue scan, restricted to issues updated since a time, in a stable order."""
    parts = [f"({query})"] if query else []
    if updated_from:
        parts.append(f'updated >= "{updated_from}"')
    return " AND ".join(parts) + (" " if parts else "") + "ORDER BY updated ASC"


def _name(x: object, key: str = "displayName") -> str | None:
    return x.get(key) if isinstance(x, dict) else None


def issue_row(item: dict, epic_field: str = "customfield_10014") -> dict:
    """An issue of the search's response as a row of ISSUE_SCHEMA; rich documents stay JSON for `rich_document_text`."""
    f = item.get("fields") or {}
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    parent = f.get("parent") or {}
    of_parent = parent.get("fields") or {}
    comments = ((f.get("comment") or {}).get("comments")) or []
    return {
        "issue_key": item.get("key"), "title": f.get("summary"), "status": _name(f.get("status"), "name"), "type": _name(f.get("issuetype"), "name"), "priority": _name(f.get("priority"), "name"), "assignee": _name(f.get("assignee")), "reporter": _name(f.get("reporter")),
        "labels": list(f.get("labels") or []), "description": text(f.get("description")), "created": f.get("created"), "updated": f.get("updated"), "epic_link": f.get(epic_field), "parent": parent.get("key"), "parent_type": _name(of_parent.get("issuetype"), "name"), "parent_summary": of_parent.get("summary"),
        "comments": [{"author": _name(c.get("author")) or "Unknown", "date": c.get("created"), "body": text(c.get("body"))} for c in comments],
    }


def wiki_row(item: dict, base_url: str = "", comments: list[str] = []) -> dict:
    """A wiki page of the search's response as a row of PAGE_SCHEMA. Cloud answers wrap it in `content`."""
    page = item.get("content") or item
    version = page.get("version") or {}
    link = (page.get("_links") or {}).get("webui")
    return {
        "page_id": str(page.get("id")), "title": page.get("title"), "space": (page.get("space") or {}).get("key"), "modified": version.get("when") or item.get("lastModified"), "url": base_url + link if link else None,
        "ancestors": [a.get("title") or "" for a in page.get("ancestors") or []], "storage": ((page.get("body") or {}).get("storage") or {}).get("value"), "comments": comments,
    }


def read_wiki(read: Callable[[int, int], dict], base_url: str = "", size: int = WIKI_PAGE, read_comments: Callable[[str], list[dict]] | None = None) -> Iterator[dict]:
    """Rows of a wiki search (`results`, `size`, by offset and count), each with the storage of its comments (a scan of its own)
    if there is a reader for them. A page of fewer rows than asked for is the last."""
    start = 0
    while True:
        got = read(start, size).get("results") or []
        for item in got:
            page = item.get("content") or item
            own = [((c.get("body") or {}).get("storage") or {}).get("value") or "" for c in read_comments(str(page.get("id")))] if read_comments else []
            yield wiki_row(item, base_url, own)
        if len(got) < size:
            return
        start += size


def read_blocks(children: Callable[[str, str | None], dict], page_id: str, depth: int = BLOCK_DEPTH) -> Iterator[dict]:
    """All blocks of a page as rows of BLOCK_SCHEMA, each after its parent: children by cursor (`results`, `has_more`,
    `next_cursor`), then their own, down to `depth` levels. Blocks deeper than that aren't asked for; a level whose pages can't
    be read is left out."""
    pos = 0

    def level(parent: str, above: str | None, at: int) -> Iterator[dict]:
        nonlocal pos
        if at >= depth:
            return
        cursor = None
        while True:
            got = retry(lambda: children(parent, cursor), times=3, delay=0.0, skip=True)
            if got is None:
                return
            for b in got.get("results") or []:
                kind = b.get("type") or ""
                yield {"page_id": page_id, "block_id": b["id"], "parent_id": above, "pos": pos, "block_type": kind, "data": json.dumps(b.get(kind) or {}), "depth": at}
                pos += 1
                if b.get("has_children"):
                    yield from level(b["id"], b["id"], at + 1)
            cursor = got.get("next_cursor")
            if not got.get("has_more") or not cursor:
                return

    yield from level(page_id, None, 0)


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in (self.options.get("keys") or "").split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, name = self.options["reader"].rsplit(".", 1)
        rows = getattr(__import__(module, fromlist=[name]), name)
        for item in rows(partition.value):
            yield tuple(item.get(c) for c in self.schema.fieldNames())


class RowsSource(DataSource):
    """`spark.read.format("rows").schema(...).option("reader", "module.function").option("keys", "A,B")`: the function gives the
    rows (dicts) of one key (a project, a space, a page); each key is a partition of its own."""

    @classmethod
    def name(cls) -> str:
        return "rows"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options)
