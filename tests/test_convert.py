from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.operators import convert as cv
from marlstone.operators.graph import louvain
from marlstone.sources import files, paged


def test_headings_and_long_sections():
    got = cv.heading_sections("intro\n# A #\nbody\n## B\n\n### C\n" + "word " * 400 + "\n#### D\nx")
    assert got[0] == {"heading": None, "text": "intro"} and got[1] == {"heading": "A", "text": "body"}
    assert all(g["heading"] == "C" and len(g["text"]) <= 1000 for g in got[2:]) and len(got) > 3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60))
def test_split_loses_no_word(text, size):
    parts = cv.recursive_split(text, size, size // 4)
    assert all(len(p) <= size for p in parts)
    joined = "".join(parts)
    assert set(text) - set(" \n") <= set(joined)


def test_sessions_overlap_by_one_exchange():
    turns = [t for i in range(4) for t in (("user", f"question {i} " + "x" * 300), ("assistant", "answer " + "y" * 300))]
    got = cv.exchange_groups(turns, 1300, 10)
    assert [g["heading"] for g in got] == ["Turns 1-2", "Turns 2-3", "Turns 3-4"]


def test_html_to_markdown():
    got = cv.html_markdown("<h2>T</h2><p>a <b>b</b><script>x()</script></p><ul><li>i<ul><li>j</li></ul></li></ul><table><tr><th>h|1</th><th>k</th></tr><tr><td>1</td></tr></table><pre>c  d</pre>")
    assert got == "## T\n\na **b**\n- i\n  - j\n\n| h\\|1 | k |\n| --- | --- |\n| 1 |  |\n\n```\nc  d\n```"


def test_blocks():
    assert cv.block_markdown("to_do", '{"rich_text": [{"plain_text": "x", "annotations": {"bold": true}}], "checked": true}') == "- [x] **x**"
    assert cv.block_markdown("equation", '{"expression": "a^2"}') == "$$a^2$$"
    assert cv.block_markdown("paragraph", '{"rich') == ""


def test_frontmatter(spark):
    text = '---\ntitle: "a \\"b\\""\ntags:\n  - x\n  - y\nstatus: open\n---\nbody'
    df = spark.createDataFrame([(text,), ("no",), (None,)], "t string").select(cv.frontmatter("t").alias("f"), cv.strip_frontmatter(F.col("t")).alias("b"))
    a, b, c = df.collect()
    assert a["f"] == {"title": 'a "b"', "tags": "x, y", "status": "open"} and a["b"] == "body" and b["f"] == {} and c["b"] is None


def test_tree_text(spark):
    doc = '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"a"}]},{"type":"bulletList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"b"}]}]}]}]}'
    assert [r[0] for r in spark.createDataFrame([(doc,), ("plain",), ("{bad",)], "t string").select(cv.rich_document_text("t")).collect()] == ["a\nb", "plain", "{bad"]


def test_louvain():
    cliques = [(a, b, 0.9) for g in ("abc", "def") for a in g for b in g if a < b] + [("c", "d", 0.1)]
    got = louvain(cliques)
    assert len({got[x] for x in "abc"}) == 1 and len({got[x] for x in "def"}) == 1 and got["a"] != got["d"]


def test_file_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a/x.md").write_text("---\nissue_key: K-1\n---\nhello")
    (tmp_path / "a/y.png").write_bytes(b"\x89PNG")
    (tmp_path / "a/z.md").write_bytes(b"\xff\xfe\x00")
    (tmp_path / ".git/c.md").write_text("no")
    f = files.scan_files(spark, str(tmp_path))
    t = files.text_files(f)
    assert {r["path"] for r in f.collect()} == {"a/x.md", "a/z.md"}
    assert {r["path"]: r["error"] for r in t.collect()} == {"a/x.md": None, "a/z.md": "not utf-8"}
    assert files.documents_from_files(t).first()["text"] == "hello" and files.existing_keys(t).first()[0] == "K-1"
    assert {r["pattern"]: r["hits"] for r in files.exclude_hits(f, ["x", "nope"]).collect()} == {"x": 1, "nope": 0}


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").schema("id int, name string").option("reader", "marlstone.sources.paged.numbered").option("total", "23").option("size", "5").option("partitions", "3").load()
    assert sorted(r["id"] for r in df.collect()) == list(range(23))


def test_batches_skip_bad_items():
    def read(start, n):
        if 3 in range(start, start + n):
            raise OSError
        return list(range(start, start + n))

    assert list(paged.read_batches(read, 8, 4)) == [0, 1, 2, 4, 5, 6, 7]
    assert list(paged.read_cursor(lambda c: ([1], "x") if c is None else ([2], None))) == [1, 2]


def test_read_through(spark, tmp_path):
    calls = []
    read = lambda: calls.append(1) or spark.range(3)
    assert paged.read_through(spark, str(tmp_path), {"q": 1}, read).count() == paged.read_through(spark, str(tmp_path), {"q": 1}, read).count() == 3
    assert len(calls) == 1
