"""WARC round trips, preference segments against plain Python, page extraction."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attestra.llm import html_cut as hc
from attestra.llm import warc
from attestra.llm.preference import preference_segments, replies
from attestra.llm.queries_pages import _PREFERENCE_SQL

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    same = "<p>copy</p>" * 50
    noise = lambda: "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(3000))
    rows = [(i, f"http://x.example/{i}?q=é\n", noise() if i % 3 else same) for i in range(90)]
    rows += [(90, None, None), (91, "u", ""), (None, "u", same), (93, "u", "x" * 300_000), (93, "u", "x" * 300_000), (None, "v", "single")]
    return spark.createDataFrame(rows, PAGES)


def expected(rows, least):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        newest = max(ids, default=None)
        revisit = len(payload) >= least and newest is not None and (page_id is None or page_id < newest)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", newest if revisit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("split, least", [(700, 0), (1 << 20, 0), (5000, 100)])
def test_round_trip(spark, pages, split, least):
    listed = warc.write_archives(pages.repartition(3), min_bytes=least, archive_bytes=60_000)
    got = warc.read_archives(spark, listed, split_bytes=split)
    rows = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(repr, map(tuple, rows))) == expected(list(map(tuple, pages.collect())), least)
    assert got.where("NOT intact").count() == 0
    payloads = {(r.page_id, bytes(r.payload)) for r in got.where("record_type = 'response'").collect()}
    texts = {(r.page_id, (r.html or "").encode()) for r in pages.collect()}
    assert payloads <= texts
    for row in listed.collect():  # other readers see ordinary gzip files
        assert gzip.open(row.path.removeprefix("file://")).read().count(b"WARC/1.1\r\n") >= row.records


def test_false_magic_and_damage():
    inner = warc.record("response", [], warc.MAGIC + b"not a member " + warc.MAGIC)
    fake = warc.MAGIC + b"\x00" * 20
    plain = gzip.compress(b"no record at all", mtime=0)
    cut = warc.record("response", [("X", "y")], b"body")[:-9]
    data = fake + inner + plain + inner + cut + inner
    read = lambda at, n: data[at : at + n]
    starts = [m.start for m in warc.members(read, 0, len(data))]
    assert starts == [len(fake), len(fake + inner + plain), len(data) - len(inner)]
    for step in (1, 7, 64):  # every record has one owner
        assert [m.start for a in range(0, len(data), step) for m in warc.members(read, a, min(a + step, len(data)))] == starts


def test_no_pages(spark, pages):
    assert warc.read_archives(spark, warc.write_archives(pages.where("false"))).count() == 0


def test_long_headers_and_text_ids(spark):
    rows = [("a b/é", "http://x.example/" + "é" * 22_000, "one"), ("z", "u", "one"), (None, "v", "two"), ("", "w", "three")]
    listed = warc.write_archives(spark.createDataFrame(rows, PAGES.replace("page_id long", "page_id string")))
    got = warc.read_archives(spark, listed, split_bytes=500, id_type="string")
    assert {(r.page_id, r.record_type, r.refers_to) for r in got.where("page_id <> ''").collect()} == {("a b/é", "revisit", "z"), ("z", "response", None)}
    assert got.count() == 4 and warc.lost_records(listed, got).count() == 0
    assert sum(r.records - r.read for r in warc.lost_records(listed, got.where("page_id = 'z'")).collect()) == 3
    assert warc.read_archives(spark, listed).where("page_id IS NOT NULL").count() == 0


def test_payloads_do_not_move(spark, pages):
    listed = warc.write_archives(pages, broadcast_rows=0)  # the same rows by a shuffle
    assert warc.read_archives(spark, listed, payloads=False).count() == pages.count()


TURNS = "pair_id long, turn long, role string, text string"


def brute_segments(chosen, rejected):
    out = []
    norm = lambda rows, p: sorted((-1 if t is None else t, r or "", x or "") for q, t, r, x in rows if q == p)
    for pair in {r[0] for r in chosen + rejected}:
        a, b = norm(chosen, pair), norm(rejected, pair)
        turns = sorted({t for t, *_ in a + b})
        cut = next((t for t in turns if [x for x in a if x[0] == t] != [x for x in b if x[0] == t]), None)
        for part, rows in (("chosen", a), ("rejected", b)):
            for t, role, text in rows:
                shared = cut is None or t < cut
                if shared and part == "rejected":
                    continue
                head, segment = f"<|{role}|>\n", f"<|{role}|>\n{text}<|end|>\n"
                trained = len(segment) - len(head) if not shared and role == "assistant" else 0
                out.append((pair, "prompt" if shared else part, t, role, segment, len(segment) - trained, trained))
    return sorted(map(repr, out))


def test_segments(spark):
    rng, chosen, rejected = random.Random(6), [], []
    for p in range(40):
        turns = [(p, t, ("user", "assistant")[t % 2], f"text {rng.randrange(9)}") for t in range(rng.randint(0, 9))]
        other = list(turns)
        if turns and p % 4:
            at = rng.randrange(len(turns))
            other[at:] = [(p, t, ("user", "assistant")[t % 2], f"other {t}") for t in range(at, at + rng.randint(0, 4))]
        chosen += turns
        rejected += other
    odd = [(100, None, "user", "a"), (100, 0, None, None), (100, 1, "assistant", "x" * 100_000), (100, 1, "assistant", "x" * 100_000), (None, 0, "user", "null pair")]
    chosen, rejected = chosen + odd, rejected + odd[:3] + [(101, 0, "assistant", "alone")]
    frames = [spark.createDataFrame(rows, TURNS).withColumn("cut", F.lit("clash")) for rows in (chosen, rejected)]
    got = preference_segments(*frames).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_segments(chosen, rejected)
    assert preference_segments(*[f.where("false") for f in frames]).count() == 0


def test_turns_of_many_rows(spark):
    """Each row of a turn counts, in whatever order they come, also where turns and pairs are null."""
    rng, chosen, rejected = random.Random(8), [], []
    for p in range(60):
        turn = (p, 0, None)[p % 3]
        rows = [(p if p else None, turn, "user", f"text {rng.randrange(50)}") for _ in range(3 + p % 7)]
        other = rng.sample(rows, len(rows))
        if p % 4:
            other[0] = (*other[0][:3], f"changed {p}")
        elif p % 8:
            other[0] = other[1]  # as many rows, other numbers of each
        chosen += rows
        rejected += other
    got = preference_segments(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_segments(chosen, rejected)


def test_replies_match_sql(spark):
    import duckdb

    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (0, 3, "assistant", "d"), (0, 4, "user", "e")]
    rows += [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (None, 0, "assistant", None), (3, None, None, None)]
    rows += [(4, 1, "assistant", "same"), (4, 3, "assistant", "same")]
    frame = spark.createDataFrame(rows, TURNS.replace("pair_id", "conv_id"))
    got = preference_segments(*replies(frame)).collect()
    conversations = frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = duckdb.sql(_PREFERENCE_SQL).fetchall()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_extraction():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head>
    <body class="has-sidebar"><header class="site-header"><a href="/">Home</a> Site name</header>
    <nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
    <div class="cookie-notice">We use cookies. Please accept all of them for a better experience on this site.</div>
    <div id="content"><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b>text&nbsp;and a <a href="x">link</a>, long enough to count.
    <p>Short one.<br>Next line.</p><ul><li>Item one of the list<li>Item two of the list</ul>
    <div class="ad">Buy this now, it is the best thing that anyone has ever sold on the whole web.</div>
    <p>Last paragraph: a &lt; b &#8364; 5, and it closes the article with a full sentence.</p></div>
    <aside>Related: some other story that has nothing to do with this one at all.</aside>
    <form><p>Your email address so that we can send you a letter every single day.</p></form>
    <section id="comments"><p>Great article, I have read it twice and will tell all of my friends.</p></section>
    <footer>&copy; 2020 Someone, all rights reserved.</footer><!-- <p>hidden</p> --></body></html>"""
    assert hc.main_text(page).split("\n\n") == [
        "Title & more", "First paragraph with boldtext and a link, long enough to count.", "Short one. Next line.",
        "Item one of the list", "Item two of the list",
        "Last paragraph: a < b € 5, and it closes the article with a full sentence.",
    ]


def _article(body):
    return f"<article><p>The first paragraph says what this is all about.</p>{body}<p>The last paragraph ends the article.</p></article>"


@pytest.mark.parametrize(
    "body, kept",
    [
        ('<p>An icon <svg width="1"/> inside a line.</p>', "An icon inside a line."),
        ("<p>A picture <svg><svg><text>no</text></svg><text>no</text></svg> nested.</p>", "A picture nested."),
        ("<p>Never closed <svg><path d='x'></p><p>The page goes on after it.</p>", "Never closed\n\nThe page goes on after it."),
        ("<p>Two <object><object>no</object><p>no</p></object> objects.</p>", "Two objects."),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>", "So x=2 holds."),
        ('<section class="related-work"><p>Earlier papers study the same question at length.</p></section>', "Earlier papers study the same question at length."),
        ('<section id="comments-on-the-law"><p>The court read the law in another way than most.</p></section>', "The court read the law in another way than most."),
        ('<section class="related-posts"><p>Another story that has nothing to do with this one.</p></section>', ""),
        ('<div id="comments"><p>I have read it twice and will tell all of my friends.</p></div>', ""),
    ],
)
def test_article_parts(body, kept):
    first, last = "The first paragraph says what this is all about.", "The last paragraph ends the article."
    assert hc.main_text(_article(body)) == "\n\n".join(x for x in (first, kept, last) if x)


def test_cut_overrules_a_block_alone():
    """A short line in a page without hints looks like boilerplate alone, not between two paragraphs."""
    long = "A paragraph of the page that is long enough to be told as content by itself, with its end."
    page = f"<body><p>{long}</p><p>In short</p><p>{long}</p></body>"
    costs = hc.Costs()
    scores = [hc.evidence(b, costs) for b in hc._Parser(costs).blocks(page)]
    assert scores[1] < 0 < scores[0]
    assert hc.main_text(page) == f"{long}\n\nIn short\n\n{long}"


def test_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 9)
        scores = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 3]) for _ in range(n)]
        edges = [(i, i + 1, rng.choice([0.2, 0.8])) for i in range(n - 1)] + [(0, n - 1, 0.4)] * (n > 2)
        cost = lambda keep: sum(abs(s) for s, k in zip(scores, keep) if (s > 0) != k and s) + sum(c for a, b, c in edges if keep[a] != keep[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(hc.minimum_cut(scores, edges)) == pytest.approx(best)


def test_page_edges(spark):
    long = "<article>" + "<p>A sentence of the page that goes on.</p>" * 3000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text without any markup at all, that is still a page."), (4, "u", long), (4, "u", long), (None, "u", "<nav>x</nav>"), (6, "u", "<p title='a>b>open <div <b"), (7, "u", "<p " + "x" * 100_000)]
    got = hc.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 8 and by[1].text == by[2].text == by[None].text == ""
    assert by[3].text.startswith("plain text") and by[4].text.count("\n\n") == 2999 and by[4].n_chars == len(by[4].text)
    assert hc.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_archive_folder_is_shared(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/archives"
    listed = warc.write_archives(pages, folder=folder)
    assert all(r.path.startswith(folder) and Path(r.path.removeprefix("file://")).stat().st_size == r.bytes for r in listed.collect())
