"""Main text and WARC derivatives."""

import gzip
import hashlib
import http.client
import io
import itertools
import json
import zlib
from collections import Counter

import zstandard

from packwise.llm import site_tree, warc
from packwise.llm.html_blocks import read

SCHEMA = "page_id long, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First   para</b><br>goes&nbsp;on<p>Second <i>para</i></p>
<div class="share">Share me</div><ul><li>one<li>two</ul><form>Sign <input> up</form></article>
<aside>Side</aside><section id="comments"><p>Great read!</p></section>
<footer>&copy; site</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_main_text():
    assert site_tree.main_text(PAGE, set()) == "Head & line\nFirst para goes on\nSecond para\none\ntwo"
    assert site_tree.main_text(None, set()) == site_tree.main_text("", set()) == site_tree.main_text("<p>", set()) == ""
    assert site_tree.main_text("<p>cut off <b>here &am", set()) == "cut off here &am"
    assert site_tree.main_text("a &lt;b&gt; <!-- no --> c<script>x", set()) == "a <b> c"


def test_deep_and_odd_markup():
    assert site_tree.main_text("<div>" * 5000 + "deep" + "</div>" * 5000, set()) == "deep"
    assert site_tree.main_text("<p title='a>b' class=x>q</p><p \"odd>r", set()).startswith("q")
    blocks, _ = read("<table><tr><td>a<td>b<tr><td>c</table>")
    assert [b.text() for b in blocks] == ["a", "b", "c"]


def test_article_keeps_what_only_sounds_like_noise():
    page = ('<article><h2 id="promotion-and-career">Head</h2><section id="social-policy"><p>Policy</p></section>'
            '<div class="related-work notice">Work</div><figure><figcaption>Caption</figcaption></figure>'
            '<fieldset>Set <label>Label</label></fieldset><p>Let <math><mi>x</mi><annotation>tex</annotation></math> be</p>'
            '<xmp><b>&amp;</b></xmp><div class="share">Share</div><div id="comments">Hm</div><div hidden="">no</div></article>')
    assert site_tree.main_text(page, set()) == (
        "Head\nPolicy\nWork\nCaption\nSet Label\nLet x be\n<b>&amp;</b>")


def test_tree_sees_every_block(spark):
    page = ("<body><div class=top>Same top</div><main><p>Story {0} told at length, {0} times</p></main>"
            "<div class=text><p>Aside the main part {0}</p></div><article><a>Teaser {0}</a></article>"
            "<div class=social-wall><p>{1}</p></div><nav>Menu {0}</nav></body>")
    rows = [(i, "http://a.example/", page.format(i, f"Wall {i % 6}")) for i in range(12)]
    df = pages(spark, rows)
    for r in site_tree.extract(df).collect():
        i = r["page_id"]
        # The wall's words name nothing: its texts come twice each, which half the evidence doesn't make low.
        assert r["text"] == f"Story {i} told at length, {i} times\nAside the main part {i}\nTeaser {i}\nWall {i % 6}"
    rows = site_tree.seen(df.selectExpr("'a.example' AS host", "page_id AS key", "html"))
    tree = site_tree.style_tree(site_tree.counts(rows))
    found = {round(r["composite"], 3) for r in tree.where("own").collect()}
    assert site_tree.templates(site_tree.counts(rows)).count() == 1
    assert tree.where("own").count() == 6 and found == {0.0, 1.0, 0.361}


def test_templates_outweigh_short_stories(spark):
    legal = "All rights reserved, without exception. " * 5
    page = "<body><p class=s>Story {}</p><div class=x>{}</div><div class=y>{}</div></body>"
    rows = [(i, "http://a.example/", page.format(i, legal, "Banner" if i < 6 else "")) for i in range(200)]
    # A node that mostly says one thing, and on some pages something of its own.
    odd = "<body><div class=t>{}</div><p>Page {}</p></body>"
    rows += [(1000 + i, "http://b.example/", odd.format("Please log in" if i >= 3 else f"Only here {i}", i)) for i in range(60)]
    # Copies that differ in a script and an advert.
    copy = "<body><script>t({0})</script><div class=ad>Ad {0}</div><p>One text</p></body>"
    rows += [(2000 + i, "http://c.example/", copy.format(i)) for i in range(20)]
    text = {r["page_id"]: r["text"] for r in site_tree.extract(pages(spark, rows)).collect()}
    assert len(text) == 280
    assert all(text[i] == f"Story {i}" for i in range(200))
    assert all(text[1000 + i] == (f"Only here {i}\n" if i < 3 else "") + f"Page {i}" for i in range(60))
    assert all(text[2000 + i] == "One text" for i in range(20))


def test_ends_of_unopened_elements_close_nothing():
    deep = "<div>" * 254 + "<article>" + "<div>" * 10 + "in" + "</div>" * 10 + "still</article>" + "</div>" * 254
    blocks, _ = read(deep)
    assert [b.text() for b in blocks] == ["in", "still"]
    assert [b.holder.depth for b in blocks] == [256, 255]
    blocks, _ = read("<ul><li>" + "<div>" * 254 + "<ul><li>a<li>b</ul>c" + "</div>" * 254 + "d</ul>")
    assert [(b.text(), b.holder.depth) for b in blocks] == [("a", 256), ("b", 256), ("c", 256), ("d", 2)]


def test_templates_go_and_content_stays(spark):
    body = "<body><div class=x>{}</div><div class=box>Same words on every page</div></body>"
    rows = [(i, f"http://site.example/{i}", body.format(f"Story number {i} tells of matters {i * 7}")) for i in range(12)]
    rows += [(100 + i, f"http://few.example/{i}", body.format(f"Story {i}")) for i in range(3)]
    rows += [(200, None, None), (201, "not a url", "<p>x</p>"), (202, "", ""), (None, "http://site.example/z", "<p>y</p>")]
    rows += [(300, "http://copies.example/", "<body><p>One text, many copies</p></body>")] * 8
    df = pages(spark, rows).selectExpr("*", "'x' AS text", "'y' AS host", "'z' AS _low")
    got = site_tree.extract(df).collect()
    text = {}
    for r in got:
        text.setdefault(r["page_id"], []).append(r["text_"])
    assert all(text[i] == [f"Story number {i} tells of matters {i * 7}"] for i in range(12))
    assert text[100] == ["Story 0\nSame words on every page"]
    assert text[200] == [""] and text[201] == ["x"] and text[202] == [""] and text[None] == ["y"]
    assert text[300] == ["One text, many copies"] * 8
    assert site_tree.extract(pages(spark, [])).count() == 0


def test_site_query_covers_every_page(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = site_tree.extract(table).collect()
    assert len(got) == table.count()
    for r in got:
        inside = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert r["text"] == site_tree.main_text(f"<article>{inside}</article>", set())


def response(body: bytes, **fields) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: 1\r\n\r\n" + body
    named = {"WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a.example/", "WARC-Date": "2024-01-01T00:00:00Z",
             "WARC-Payload-Digest": "sha1:ABC"} | fields
    return warc.build("response", list(named.items()), block)


def test_derived_records():
    meta, text = warc.derived(response(b"<p>Hello <b>you</b></p><script>no</script><p>two"))
    assert [r[0] for r in (meta, text)] == ["metadata", "conversion"]
    assert meta[2] == text[2] == "<urn:uuid:1>" and meta[3] == "http://a.example/" and text[8] == "sha1:ABC"
    head, body = warc.split_head(text[10])
    assert body == b"Hello you\ntwo\r\n\r\n" and b"WARC-Refers-To: <urn:uuid:1>" in head
    assert text[7] == "sha256:" + hashlib.sha256(b"Hello you\ntwo").hexdigest() and text[6] == 13
    about = json.loads(warc.split_head(meta[10])[1])
    assert ["X-A", "1"] in about["http-headers"] and ["WARC-Payload-Digest", "sha1:ABC"] in about["source"]
    assert about["http-status"] == "HTTP/1.1 200 OK"
    assert warc.derived(response(b"x")) == warc.derived(response(b"x"))


def test_unreadable_records_stay_in_sight():
    reasons = [warc.derived(r)[0] for r in (b"", b"junk", b"WARC/1.1\r\nWARC-Type: request\r\n\r\n",
                                            response(b"x")[:-60], warc.build("response", [], b"no http"))]
    assert [r[0] for r in reasons] == ["unreadable"] * 5 and all(r[9] for r in reasons)


def test_responses_and_derivatives_of_pages(spark):
    rows = [(1, "http://a.example/", "<p>Hi"), (1, "http://a.example/", "<p>Hi"), (2, None, None), (None, "x\r\ny", "")]
    got = warc.derive(warc.responses(pages(spark, rows))).collect()
    assert len(got) == 8 and {r["warc_type"] for r in got} == {"metadata", "conversion"}
    hi = [r for r in got if r["warc_type"] == "conversion" and r["content_length"] == 2]
    assert len(hi) == 2 and hi[0]["record_id"] == hi[1]["record_id"]
    assert hi[0]["source_digest"] == "sha256:" + hashlib.sha256(b"<p>Hi").hexdigest()
    assert warc.derive(warc.responses(pages(spark, []))).count() == 0
    odd = spark.createDataFrame([(None,), (bytearray(b"junk"),)], "record binary")
    assert [r["warc_type"] for r in warc.derive(odd).collect()] == ["unreadable"]


# Bodies as servers send them, against the standard library's own reading of the same response


def sent(body, headers, **fields):
    block = b"HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + body
    named = {"WARC-Record-ID": "<urn:x>", "WARC-Target-URI": "http://a/b", **fields}
    return warc.build("response", list(named.items()), block), block


def chunks(body, sizes=(1, 7, 64)):
    out, at = b"", 0
    for size in itertools.cycle(sizes):
        if at >= len(body):
            return out + b"0\r\nTrailer: x\r\n\r\n"
        piece = body[at:at + size]
        out += f"{len(piece):x};note=1\r\n".encode() + piece + b"\r\n"
        at += size


class Socket:
    def __init__(self, data):
        self.data = data

    def makefile(self, *_):
        return io.BytesIO(self.data)


def test_coded_bodies_against_http_client():
    story = ("r\u00e9sum\u00e9 0 \n" * 200).encode()
    codings = {"": lambda b: b, "gzip": gzip.compress, "x-gzip": lambda b: gzip.compress(b[:99]) + gzip.compress(b[99:]),
               "deflate": zlib.compress, "zstd": zstandard.compress}
    for coding, code in codings.items():
        for chunked in (False, True):
            body = code(story)
            headers = [("Content-Type", "text/plain; charset=utf-8")] + ([("Content-Encoding", coding)] if coding else [])
            if chunked:
                body, headers = chunks(body), [*headers, ("Transfer-Encoding", "Chunked")]
            record, block = sent(body, headers)
            meta, conversion = warc.derived(record)
            assert (meta[0], conversion[0]) == ("metadata", "conversion")
            assert warc.split_head(conversion[10])[1].removesuffix(b"\r\n\r\n") == story
            response = http.client.HTTPResponse(Socket(block))
            response.begin()
            assert hashlib.sha256(code(story)).digest() == hashlib.sha256(response.read()).digest()
    stored_plain, _ = sent(story, [("Content-Type", "text/plain"), ("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")])
    assert story in warc.derived(stored_plain)[1][10]
    raw, _ = sent(zlib.compress(story)[2:-4], [("Content-Type", "text/plain"), ("Content-Encoding", "deflate")])
    assert story in warc.derived(raw)[1][10]


def test_hostile_headers_and_bodies_end_no_task(monkeypatch):
    for charset in ("idna", "undefined", "utf\0-8", "hex", "rot13", "no-such", "", "x" * 9999):
        record, _ = sent(b"<p>fine", [("Content-Type", f"text/html; charset={charset}")])
        assert b"\r\n\r\nfine\r\n" in warc.derived(record)[1][10]
    long = warc.build("response", [], b"HTTP/1.1 200 OK\r\n\r\nx").replace(b"Content-Length: ", b"Content-Length: " + b"9" * 5000)
    assert [r[0] for r in warc.derived(long)] == ["unreadable"]
    cut = gzip.compress(b"x" * 9999)
    for body, headers, reason in (
            (b"\x89PNG", [("Content-Type", "image/png")], "not text: image/png"), (b"a\0b", [], "not text"),
            (cut[:20], [("Content-Encoding", "gzip")], "breaks off"), (cut[:15] + b"\xff" * 20, [("Content-Encoding", "gzip")], ""),
            (b"x", [("Content-Encoding", "br")], "content coding br"), (b"zz", [("Content-Encoding", "deflate")], "coding")):
        record, _ = sent(body, headers)
        meta, bad = warc.derived(record)
        assert (meta[0], bad[0], bad[2]) == ("metadata", "unreadable", "<urn:x>") and reason in bad[9] and bad[10] == record
    monkeypatch.setattr(warc, "MOST", 5000)
    assert "over 5000" in warc.derived(sent(cut, [("Content-Encoding", "gzip")])[0])[1][9]


def test_large_bodies_inflate_whole():
    body = b"x" * (5 * warc.PIECE + 17)
    assert warc.uncoded(gzip.compress(body), "gzip") == body == warc.uncoded(zlib.compress(body, 1), "deflate")
    assert warc.uncoded(zstandard.compress(body), "zstd") == body


def test_records_of_files(spark, tmp_path):
    records = [sent(f"<p>page {i}".encode() * i, [])[0] for i in range(7)]
    assert [list(warc.records_of(x)) for x in (b"".join(records), b"".join(map(gzip.compress, records)),
                                              gzip.compress(b"".join(records)))] == [records] * 3
    broken = b"".join(map(gzip.compress, records[:3])) + gzip.compress(records[3])[:-9]
    got = list(warc.records_of(broken))
    assert got[:3] == records[:3] and len(got) == 4
    assert list(warc.records_of(b"")) == [] and list(warc.records_of(b"junk")) == [b"junk"]
    assert list(warc.records_of(records[0] + b"junk\r\n\r\n")) == [records[0], b"junk\r\n\r\n"]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "y.warc").write_bytes(b"".join(records[:2]) + b"junk")
    (tmp_path / "empty.warc").write_bytes(b"")
    read = warc.read_files(spark, str(tmp_path))
    assert sorted((r["path"][-6:], r["place"], bytes(r["record"])) for r in read.collect()) == sorted(
        [("arc.gz", i, r) for i, r in enumerate(records)] + [("y.warc", 0, records[0]), ("y.warc", 1, records[1]), ("y.warc", 2, b"junk")])
    kinds = Counter(r["warc_type"] for r in warc.derive(read).collect())
    assert kinds == {"metadata": 9, "conversion": 9, "unreadable": 1}
