import hashlib
import os
import re
import zipfile
from html import unescape

import numpy as np
import pytest

from eigenweave.llm import html_extract, warc, zip_range
from eigenweave.llm.common import local_path, scratch
from eigenweave.llm.crf import LinearChain
from eigenweave.llm.dom import blocks
from eigenweave.llm.queries import op2_html_extraction, op7_warc

PAGES = "page_id long, url string, html string, digest string, text int"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>a<p>b", ["a", "b"]),
        ("<div>x <b>y</b>\n z<br>w</div>t", ["x y z w", "t"]),
        ("<p>1 < 2 &amp; 3 &gt; 2 &eacute;&#233;&nbsp;x</p>", ["1 < 2 & 3 > 2 éé x"]),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>yes<!-- <p>no --></p>", ["yes"]),
        ("<p title='a>b'>c</p><!-- open <p>no", ["c"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("plain", ["plain"]),
        ("", []),
        ("<p", []),
        ("</p></div><p>x</b></p>", ["x"]),
        ("<textarea>no</textarea><select><option>no</select><button>no</button>ok", ["ok"]),
        ("<a href=/x title=it's>link</a><p>one</p><p>two", ["link", "one", "two"]),
        ("<p><b don't>x</b> y</p><p>z", ["x y", "z"]),
        ("<p>a</p><video src=x><p>rest", ["a", "rest"]),
        ("<p>a <video src=x>no <p>no</p></video> b</p>", ["a b"]),
        ("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> equals", ["Energy E=m equals"]),
        ("<p>a<!-->b--></p><!---><p>c<!-- x --!>d", ["ab-->", "cd"]),
        ("<p>a<button>no<div>no</div></button>b<svg><title>t</title><text>no</svg>c", ["a b c"]),
        ("<p>a<object data=x>kept <p>b", ["a kept", "b"]),
        ('<p title="open>a</p><p>b', ["a", "b"]),
        ("<p a = 'x>y' b=\"p>q\" c=d/>t</p>", ["t"]),
        ("<script/>s</script><p>x</p><iframe src=y /><p>y", ["x", "y"]),
        ("<p>x</ >y</p><?php z ?><p>w", ["xy", "w"]),
    ],
)
def test_blocks(html, want):
    assert [b.text for b in blocks(html)] == want


def test_block_paths():
    b = blocks('<article class="post-Body main"><p style="display: none">a <a href=x>link</a></p></article><p>b')
    path = list(b[0].inside.path())[::-1]
    assert [e.tag for e in path] == ["article", "p"] and path[0].names == ("post", "body", "main") and path[1].names == ("hidden",)
    assert b[0].inside.features == {"up=article", "up=p", "name=post", "name=body", "name=main", "name=hidden"}
    assert b[0].links == 4 and [e.tag for e in b[1].inside.path()] == ["p"]
    assert list(blocks("<p class='post x'>a", frozenset(["post"]))[0].inside.names) == ["post"]


def test_deep_nesting_is_linear():
    import time
    import tracemalloc

    crf = html_extract.model()
    html = "".join(f"<div class=c{k}>x" for k in range(20_000))
    tracemalloc.start()
    began = time.time()
    text = html_extract.main_text(html, crf)
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and took < 60 and set(text) <= {"x", "\n"}
    for bad in ("<a =\"" * 20_000, "<p title='" * 20_000, "<" * 50_000, "<!--" * 20_000, "</" * 20_000, "<button>" * 5000):
        began = time.time()
        blocks(bad)
        assert time.time() - began < 10


def test_crf_matches_enumeration():
    crf = LinearChain()
    rng = np.random.RandomState(0)
    crf.weights = {f"f{k}": float(w) for k, w in enumerate(rng.randn(5))}
    crf.moves, crf.ends = rng.randn(2, 2), rng.randn(2, 2)
    page = [[f"f{k}" for k in range(5) if rng.rand() < 0.5] for _ in range(6)]
    score = {}
    for code in range(64):
        y = [code >> t & 1 for t in range(6)]
        s = crf.ends[0, y[0]] + crf.ends[1, y[-1]] + sum(crf.moves[a, b] for a, b in zip(y, y[1:]))
        score[tuple(y)] = s + sum(e for e, v in zip(crf.scores(page), y) if v)
    z = np.logaddexp.reduce(list(score.values()))
    single, pairs = crf.marginals(page)
    for t in range(6):
        assert single[t, 1] == pytest.approx(sum(np.exp(s - z) for y, s in score.items() if y[t]))
    assert pairs[2, 1, 0] == pytest.approx(sum(np.exp(s - z) for y, s in score.items() if (y[2], y[3]) == (1, 0)))
    assert crf.decode(page) == list(max(score, key=score.get))
    assert crf.decode([]) == []


def test_held_out_layouts():
    crf, hit, said, true = html_extract.model(), 0, 0, 0
    for found, y in html_extract.labelled(99, 200):
        p = crf.decode(html_extract.features(found))
        hit += sum(a & b for a, b in zip(p, y))
        said, true = said + sum(p), true + sum(y)
    assert hit / said > 0.98 and hit / true > 0.98


def test_extraction_query(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op2_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    same = 0
    for r in got:
        html = pages[r["page_id"]]["html"]
        article = re.sub("<[^>]*>", " ", re.sub("</?(?:h1|p)>", "\0", re.search("<article>(.*?)</article>", html, re.S)[1]))
        same += r["text"] == "\n".join(x for x in (" ".join(unescape(p).split()) for p in article.split("\0")) if x)
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
    assert same == len(got)


def test_extraction_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav><a>x</a></nav>"), (1, "u", "<article><p>" + "Long text, it is. " * 20_000 + "</p></article>")]
    got = html_extract.extract(spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)).collect()
    assert [r["n_chars"] for r in got] == [0, 0, 0, 359_999] and got[0]["text"] == ""
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def expected(rows):
    first = {}
    for i, html in rows:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, html in rows:
        p = (html or "").encode()
        to = first.get(p)
        to = None if to is None or to == i or sum((h or "").encode() == p for _, h in rows) == 1 else to
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_warc_query(spark, sf):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in op7_warc(spark, sf).collect()), key=str)
    assert got == expected(rows)


def test_warc_round_trip_and_edges(spark):
    long, other = "é<p>\r\n\r\nWARC/1.1\r\n" * 9, "x" * 100
    rows = [(5, long), (2, long), (9, long), (None, long), (3, "x" * 99), (4, "x" * 99), (6, None), (7, ""), (8, other), (None, "y" * 300), (None, "y" * 300), (10, "z" * 500_000)]
    url = {5: "http://a/\r\nX: y", 2: None}
    pages = spark.createDataFrame([(i, url.get(i, "http://b/?q=: 1"), h, "d", 1) for i, h in rows], PAGES).repartition(3)
    out = scratch(spark, "warc")
    made = warc.write_archives(pages, out)
    got = warc.read_archives(spark, out, made).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
    assert {r["page_id"]: bytes(r["payload"]) for r in got if r["page_id"] == 2}[2].decode() == long
    assert {r["url"] for r in got if r["page_id"] == 2} == {None} and all("\n" not in (r["url"] or "") for r in got)
    names = [r["archive"] for r in made.collect()]
    for name in names:  # the packages are valid for other readers
        with zipfile.ZipFile(f"{local_path(out)}/{name}") as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert warc.write_archives(pages.where("false"), scratch(spark, "warc")).count() == 0


def test_damage_is_an_error(spark, tmp_path):
    good = warc.record(1, "u", b"p" * 200, "0" * 64, None, "0.0")
    with pytest.raises(ValueError):
        warc.parse(good[:-50])


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment"])
@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(tmp_path, monkeypatch, wide, comment):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "a.zip"
    data = {"one.txt": os.urandom(5000), "dir/zwei-é.bin": b"", "three": b"abc" * 1000}
    with zipfile.ZipFile(path, "w") as z:
        for name, d in data.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                f.write(d)
        z.writestr(zipfile.ZipInfo("packed"), b"q" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = comment
    if wide:
        assert zip_range.END64 in path.read_bytes()
    read = zip_range.RangeFile(str(path))
    members = zip_range.directory(read, read.size)
    assert set(members) == {*data, "packed"}
    for name, d in data.items():
        m = members[name]
        assert m.size == len(d) and read(zip_range.data_start(read, m), m.size) == d
    with pytest.raises(ValueError):
        zip_range.data_start(read, members["packed"])
    read.close()
    path.write_bytes(path.read_bytes()[:50])
    cut = zip_range.RangeFile(str(path))
    with pytest.raises(ValueError):
        zip_range.directory(cut, cut.size)
    cut.close()


def test_digits_count_over_the_whole_block():
    block = lambda text: html_extract.Block(text, None, 0)
    assert "digits" in html_extract._shape(block("word " * 40 + "1234567890 " * 40))
    assert "digits" not in html_extract._shape(block("1234567890 " * 18 + "word " * 200))
