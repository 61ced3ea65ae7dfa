import gzip
import hashlib
import html as entities
import math
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from tidemill.llm import url_templates as tree
from tidemill.llm.html_content import content, main_text, smoothed
from tidemill.llm.url_templates import judged_urls
from tidemill.llm.warc_chunks import chunked, read_archives, read_chunks, write_archives

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul></nav><div class="cookie-notice">We use</div>
<ARTICLE><h1>A &amp; B</h1><p><b>First long
paragraph&nbsp;of   text<br><p>Short.</p><div class="ad">Buy</div><script>x="</p>"</script><!-- c --><p>Caf&eacute; &#233;</p>
<form><label>Name</label></form></ARTICLE><div id="comments"><p>Nice post</p></div><aside>side</aside><footer>foot</footer></body>"""


def test_article():
    assert content(PAGE) == "A & B\nFirst long paragraph of text\nShort.\nCafé é"


def test_dense_container_without_an_article():
    page = "<div><ul>" + "<li><a href=x>link</a></li>" * 9 + "</ul></div><div><h2>T</h2><p>" + "many words here " * 20 + "</p><p>Ok.</p><p>" + "and more of it " * 20 + "</p></div>"
    lines = content(page).split("\n")
    assert lines[0] == "T" and lines[2] == "Ok." and len(lines) == 4


@pytest.mark.parametrize("lead", ["<main><p>The lead of it.</p></main>", "<article><h2>The lead of it.</h2></article>"])
def test_body_outside_of_the_article(lead):
    body = ["many words here " * 20, "and more of it " * 20]
    page = "<nav><a href=x>link</a></nav>" + lead + "<div>" + "".join(f"<p>{p}</p>" for p in body) + "</div><div><ul>" + "<li><a href=x>link</a></li>" * 9 + "</ul></div>"
    assert content(page).split("\n") == ["The lead of it.", *(p.strip() for p in body)]


LONG = "many words of a text " * 12
KEPT = " ".join(LONG.split())
COMMENTS = "<div id=comments>" + f"<p>{LONG}</p>" * 3 + "</div>"


@pytest.mark.parametrize(
    "page",
    [f"<head><title>no</title><meta charset=x><body><p>{LONG}", f"<head><title>no</title><p>{LONG}", f"<head><script>x</script>{LONG}",
     f"<head><noscript><img src=x></noscript></head><body class='has-sidebar'><p>{LONG}", f"<article class='post tags-news'><p>{LONG}</article>",
     f"<div class='content with-comments'><p>{LONG}</p><div class='ad'>Buy</div></div>", f"<form id=aspnet><div><p>{LONG}</p></div></form>",
     f"<div class='with-sidebar'><div class='post related-x'><p>{LONG}</p></div></div><div class=sidebar>x</div>",
     f"<article><p>{LONG}</p></article>" + COMMENTS, f"<div class='page with-comments'><div><p>{LONG}</p></div>{COMMENTS}</div>"],
)
def test_furniture_does_not_empty_a_page(page):
    assert content(page) == KEPT


def test_names_beside_and_inside_an_article():
    assert content(f"<div class=ad>{LONG}</div><article><h1>Title</h1></article>") == "Title"
    assert content(f"<article><h1>Title</h1><div class='text tags-x'><p>{LONG}</p></div></article>") == "Title\n" + KEPT


def test_names_of_repeated_posts():
    assert content(f"<div class='post tags'><p>{LONG}</div>" * 2 + "<div class=sidebar>x</div>") == KEPT + "\n" + KEPT


@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), ("<", ""), ("plain", "plain"), ("<p>x</p", "x"), ("<article><p>a<p>b</article", "a\nb"), ("<script>x", ""),
     ("<article>" + "<b>" * 3000 + "x", "x"), ("<article>&am", "&am"), ("<nav>only</nav>", "")],
)
def test_broken_pages(page, text):
    assert content(page) == text


def test_smoothing():
    ratio = np.array([0.0, 0, 9, 0, 0, 0, 0, 0, 0, 0])
    for n in (3, 10):
        out = smoothed(ratio[:n])
        assert out.argmax() == 2 and (out >= 0).all() and out[0] < out[1]
    assert smoothed(np.full(20, 3.0)) == pytest.approx(np.full(20, 3.0))


def test_pages_of_the_test_set_against_a_pattern(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {r.id: r for r in main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^<>]*$", "", inside[1])) if inside else []
        lines = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts]
        expected = "\n".join(line for line in lines if line)
        assert found[r.page_id].text == expected and found[r.page_id].n_chars == len(expected)


def test_main_text_of_odd_rows(spark):
    schema = "page_id long, url string, html string, text int"
    rows = [(1, None, None, 1), (None, "u", "", 2), (2, "u", PAGE, 3), (2, "u", PAGE, 3), (3, "u", "<article><p>" + "long " * 200_000, 4)]
    got = sorted((str(r.id), r.url, r.n_chars) for r in main_text(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", None, 0), ("2", "u", 48), ("2", "u", 48), ("3", "u", 999_999), ("None", "u", 0)]
    assert main_text(spark.createDataFrame([], schema)).count() == 0


# -- archives ------------------------------------------------------------------------


def payloads():
    magic = "WARC/1.1\r\n"
    rows = [(1, "u", "a" * 50), (2, "u", "x" * 200), (3, "v", "x" * 200), (4, None, None), (None, "u", "x" * 200), (9, "w", "x" * 200)]
    rows += [(5, "u\r\nX: y", "é" * 700 + magic + "z\r\n\r\n" * 30 + magic * 2), (6, "", magic), (7, "WARC/1.1", "\r\n\r\n"), (8, "k", "WARC/1.1" * 40)]
    return rows + [(1, "u", "a" * 50), (2, "u", "x" * 200)]


def test_round_trip(spark, tmp_path):
    rows = payloads()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    for size in (64, 1 << 20):
        path = str(tmp_path / f"a{size}")
        write_archives(chunked(frame, chunk_bytes=size), path)
        got = sorted((str(r.id), r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in read_archives(spark, path).collect())
        expected = []
        for id_, _, html in rows:
            raw = (html or "").encode()
            revisit = len(raw) >= 100 and html == "x" * 200 and id_ != 2
            expected.append((str(id_), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
        assert got == sorted(expected, key=lambda r: tuple(map(str, r))) or got == sorted(expected)
        assert all(r.intact for r in read_archives(spark, path).collect())
        parts = defaultdict(dict)
        for r in read_chunks(spark, path).where("kind = 'response'").collect():
            parts[r.id, r.record_id][r.chunk] = r
            assert len(r.data) <= size
        for (id_, _), chunks in parts.items():
            raw = next((h or "").encode() for i, _, h in rows if i == id_)
            done = b""
            for n in sorted(chunks):
                done += chunks[n].data
                assert chunks[n].digest == hashlib.sha256(done).hexdigest() and chunks[n].bytes == len(done)
            assert done == raw
    for file in Path(path).glob("*.gz"):
        text = gzip.open(file).read()
        assert not text or (text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n"))


def test_damage_is_seen(spark, tmp_path):
    path = tmp_path / "a"
    write_archives(chunked(spark.createDataFrame([(1, "u", "y" * 300)], "page_id long, url string, html string"), chunk_bytes=100), str(path))
    # empty partitions leave files too
    file = next(f for f in path.glob("*.gz") if b"yyy\r\n\r\n" in gzip.open(f).read())
    raw = gzip.open(file).read().replace(b"yyy\r\n\r\n", b"yyz\r\n\r\n", 1)
    for stale in path.glob(".*.crc"):
        stale.unlink()
    file.write_bytes(gzip.compress(raw))
    assert [r.intact for r in read_archives(spark, str(path)).collect()] == [False]


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    write_archives(chunked(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert read_archives(spark, path).count() == 0


# -- urls ----------------------------------------------------------------------------


def judged(spark, rows, schema="page_id long, url string, bad boolean"):
    return {r.page_id: r for r in judged_urls(spark.createDataFrame(rows, schema), bad_column="bad").collect()}


def test_parts_and_rules(spark):
    urls = [
        None, "no scheme", "http://", "https://A.Example.ORG/es/1?x", "http://example.org/en/1x", "http://example.org/en/2",
        "http://notexample.org/es/", "http://x.com/fr/#a", "http://x.com/de/y?z", "http://x.com/fr", "http://org/", "http://x.org",
        "http://x.net?q=/a", "a://b://c/d", "http://ÉX.org/",
    ]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)])
    found = [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))]
    allow, block = "allow", "block"
    assert found == [
        ("", "", None, allow), ("", "", None, allow), ("", "", None, allow),
        ("a.example.org", "/es/1", "example.org/es/", block), ("example.org", "/en/1x", "example.org/en/1", block),
        ("example.org", "/en/2", "org/", allow), ("notexample.org", "/es/", "org/", allow),
        ("x.com", "/fr/", "com/fr/", allow), ("x.com", "/de/y", "com/de/", block), ("x.com", "/fr", None, allow),
        ("org", "/", "org/", allow), ("x.org", "", None, allow), ("x.net", "", None, allow), ("b:", "//c/d", None, allow),
        ("Éx.org", "/", "org/", allow),
    ]


def test_templates(spark):
    """Ids become wildcards; a branch with other labels than its siblings keeps its name and
    is rejected, and branches alike are merged."""
    rng = random.Random(1)
    rows = []
    for i in range(900):
        branch = ("news", "blog", "spam")[i % 3]
        bad = rng.random() < (0.95 if branch == "spam" else 0.05)
        rows.append((i, f"http://h.net/{branch}/{i}.html", bad if i % 2 else None))
    rows += [(1000 + i, f"http://other.net/p/{i}", None) for i in range(40)]
    rows += [(2000, "http://h.net/" + "/".join(map(str, range(30))), None), (2001, "http://h.net/", None), (2001, "http://h.net/", None)]
    got = judged(spark, rows)
    assert got[0].template == got[1].template == "/+</*" and got[2].template == "/spam/*"
    assert {got[i].verdict for i in range(900) if i % 3 == 2} == {"block"}
    assert {got[i].verdict for i in range(900) if i % 3 < 2} == {"allow"}
    assert got[1000].template == "/p/*" and got[1000].verdict == "allow"
    assert got[2000].template == "/*" * 30
    bad = sum(r[2] is True for r in rows if "/spam/" in r[1])
    good = sum(r[2] is False for r in rows if "/spam/" in r[1])
    all_bad, all_good = (sum(r[2] is x for r in rows) for x in (True, False))
    overall = all_bad / (all_bad + all_good)
    host = (all_bad + 10 * overall) / (all_bad + all_good + 10)
    assert got[2].purity == pytest.approx((bad + 10 * host) / (bad + good + 10))


def tree_by_hand(paths):
    """``{(host, path): template}`` of ``{(host, path): (bad, labels)}``, node by node."""

    def h(n):
        return n * math.log(n) if n else 0.0

    def ratio(b, n, bb, nn):
        return 2 * sum(h(x) + h(y - x) - h(y) for x, y in ((b, n), (bb - b, nn - n))) - 2 * (h(bb) + h(nn - bb) - h(nn))

    def groups(members, name=""):
        bb, nn = (sum(m[i] for m in members.values()) for i in (0, 1))
        parts = defaultdict(dict)
        for segment, (b, n) in members.items():
            differs = ratio(b, n, bb, nn) > 2 * math.log(len(members) / tree.ALPHA)
            parts[(">" if b * nn > bb * n else "<") if differs else "="][segment] = (b, n)
        if set(parts) <= {"="}:
            return {s: s if len(members) == 1 else "+" + name.rstrip("=") for s in members}
        return {s: n for mark, part in parts.items() for s, n in groups(part, name + mark).items()}

    found = {}

    def grow(node, rows):
        """``rows``: segments left, key, bad, labels."""
        below = defaultdict(list)
        for left, *fact in rows:
            if left:
                below[left[0]].append((left[1:], *fact))
            else:
                found[fact[0]] = node
        sums = {s: (sum(r[2] for r in below[s]), sum(r[3] for r in below[s])) for s in below}
        names = groups({s: v for s, v in sums.items() if len(below[s]) >= tree.FREQUENT or v[1] >= tree.FREQUENT})
        children = defaultdict(list)
        for s, part in below.items():
            children[names.get(s, "*")] += part
        for name, part in children.items():
            grow(f"{node}/{name}", part)

    hosts = defaultdict(list)
    for (host, path), (bad, own) in paths.items():
        hosts[host].append((path[1:].split("/") if path else [], (host, path), bad, own))
    for rows in hosts.values():
        grow("", rows)
    return found


def test_tree_by_brute_force(spark):
    rng = random.Random(5)
    paths = {}
    for host in ("a.net", "b.net", "c.net"):
        for _ in range(500):
            path = "".join(f"/{rng.choice('xyz')}{rng.randint(0, 3) if d < 2 else rng.randint(0, 40)}" for d in range(rng.randint(0, 5)))
            own = rng.choice((0, 0, 1, 2, 9))
            paths[host, path] = (sum(rng.random() < (0.9 if "x1" in path else 0.2) for _ in range(own)), own)
    got = tree.path_templates(spark.createDataFrame([(*k, *v) for k, v in paths.items()], "host string, path string, bad long, own long"))
    assert {(r.host, r.path): r.template for r in got.collect()} == tree_by_hand(paths)
    assert any(">" in r.template for r in got.collect())


def test_one_bad_section_of_many(spark):
    rows = [(i, f"http://h.net/s{i % 60}/{i}", i % 60 == 7 if i % 2 else None) for i in range(6000)]
    got = judged(spark, rows)
    assert {got[i].verdict for i in range(6000) if i % 60 == 7} == {"block"} and got[7].template == "/s7/*"
    assert {got[i].verdict for i in range(6000) if i % 60 != 7} == {"allow"}


def test_branches_far_down(spark):
    rows = [(i, "http://h.net/1/2/3/4/5/6/7/8/9/" + ("good", "bad")[i % 2] + f"/{i}", i % 2 == 1) for i in range(200)]
    got = judged(spark, rows)
    assert [got[i].verdict for i in range(200)] == ["allow", "block"] * 100


def test_branches_join_a_group_not_a_neighbour(spark):
    """Shares of 15 to 90 % of which neighbours do not differ are not all one template."""
    rows = [(1000 * k + i, f"http://h.net/s{k}/{i}", i < bad) for k, bad in enumerate((3, 7, 11, 15, 18)) for i in range(20)]
    got = judged(spark, rows)
    assert got[0].verdict == "allow" and got[4000].verdict == "block" and got[0].template != got[2000].template != got[4000].template


def test_many_like_branches_are_one(spark):
    """Chance differences between hundreds of small branches make no templates."""
    rng = random.Random(3)
    rows = [(i, f"http://h.net/s{i % 400}/{i}", rng.random() < 0.15) for i in range(2400)]
    assert {r.template for r in judged(spark, rows).values()} == {"/+/*"}


def test_segments_that_look_like_marks(spark):
    rows = [(10 * k + i, f"http://h.net/{s}/{i}", s == "*") for k, s in enumerate(("*", "+", "\\", "a")) for i in range(10)]
    got = judged(spark, rows)
    assert got[0].template == "/\\*/*" and got[0].verdict == "block" and {got[i].template for i in range(10, 40)} == {"/+/*"}


def test_hot_url_and_any_column_name(spark):
    rows = [(i, "http://h.net/hot/page", True) for i in range(300)] + [(1000 + i, f"http://h.net/p/{i}", False) for i in range(300)]
    names = ["name", "node", "own", "label", "segment", "row", "fit", "b", "group"]
    frame = spark.createDataFrame([(*r, *range(9)) for r in rows], "page_id long, url string, bad boolean, " + ", ".join(f"{n} int" for n in names))
    out = judged_urls(frame, bad_column="bad")
    assert out.columns[3:12] == names
    assert {(r.page_id < 1000, r.verdict, r.name, r.group) for r in out.collect()} == {(True, "block", 0, 8), (False, "allow", 0, 8)}


def test_no_urls_and_clashing_columns(spark):
    schema = "page_id long, url string, bad boolean"
    assert judged(spark, [], schema) == {}
    frame = spark.createDataFrame([(1, "http://a.org/x", "mine", 3)], "page_id long, url string, host string, n int")
    out = judged_urls(frame)
    assert out.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict", "template", "purity"]
    assert out.first().host == "a.org"
