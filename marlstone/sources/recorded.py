"""Recorded answers of paged services, by rule: readers for trials without a network."""

from __future__ import annotations

from collections.abc import Iterator

from marlstone.sources import paged

ISSUES, PAGES = 230, 120


def _issue(project: str, i: int) -> dict:
    comments = [{"author": {"displayName": f"user {i % 5}"} if i % 3 else None, "created": "2024-01-02", "body": f"comment {k}"} for k in range(i % 4)]
    parent = {"key": f"{project}-1", "fields": {"issuetype": {"name": "Epic"}, "summary": "first"}} if i % 10 == 5 else None
    fields = {"summary": f"issue {i}", "status": {"name": "Open" if i % 2 else "Closed"}, "issuetype": {"name": "Bug"}, "labels": [f"l{i % 3}"], "updated": f"2024-01-{i % 28 + 1:02d}", "customfield_10014": f"{project}-{i % 7 + 1}" if i % 2 else None, "comment": {"comments": comments}, "parent": parent, "description": None if i % 6 == 0 else f"text {i}"}
    return {"key": f"{project}-{i}", "fields": fields}


def issues(project: str) -> Iterator[dict]:
    """Issues of a project, paged by offset; the page at 100 fails once as a whole and is read row by row."""
    def read(start: int, n: int) -> dict:
        if start == 100 and n > 1:
            raise OSError("page")
        return {"total": ISSUES, "issues": [_issue(project, i) for i in range(start + 1, min(start + n, ISSUES) + 1)]}

    for item in paged.read_pages(read, size=50):
        yield paged.issue_row(item)


def issues_by_token(project: str) -> Iterator[dict]:
    """The same, paged by tokens."""
    def read(token: str | None) -> dict:
        start = int(token or 0)
        return {"issues": [_issue(project, i) for i in range(start + 1, min(start + 40, ISSUES) + 1)], "nextPageToken": str(start + 40), "isLast": start + 40 >= ISSUES}

    for item in paged.read_tokens(read):
        yield paged.issue_row(item)


def wiki(space: str) -> Iterator[dict]:
    """Pages of a space, wrapped as the cloud does, each with a comment where its number is divisible by 3."""
    def read(start: int, n: int) -> dict:
        return {"results": [{"content": {"id": i, "title": f"page {i}", "space": {"key": space}, "version": {"when": "2024-01-01"}, "_links": {"webui": f"/x/{i}"}, "ancestors": [{"title": "home"}] * (i % 3), "body": {"storage": {"value": f"<p>body {i}</p>"}}}} for i in range(start, min(start + n, PAGES))]}

    yield from paged.read_wiki(read, "https://wiki.example", size=50, read_comments=lambda p: [{"body": {"storage": {"value": f"on {p}"}}}] if int(p) % 3 == 0 else [])


def blocks(page: str) -> Iterator[dict]:
    """A chain of blocks twelve deep, of which ten are read, with a sibling at each level."""
    def children(parent: str, cursor: str | None) -> dict:
        at = 0 if parent == page else int(parent.rsplit(":", 1)[1]) + 1
        if cursor is None:
            return {"results": [{"id": f"{page}:{at}", "type": "toggle", "toggle": {"n": at}, "has_children": at < 12}], "has_more": True, "next_cursor": "2"}
        return {"results": [{"id": f"{page}-side:{at}", "type": "paragraph", "paragraph": {}, "has_children": False}], "has_more": False}

    yield from paged.read_blocks(children, page)
