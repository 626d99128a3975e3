"""Licence scan, language, BPE, token files and page operators against brute force."""

import base64
import gzip
import hashlib
import html.parser
import random
import re
import zlib
from urllib.parse import urljoin

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dwellmatch.llm import bpe_replay, language_ppm, license_scan, token_coder, url_filter, warc_derive
from tests.llm.util import ODD, docs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


# ---- licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_places_equal_brute_force(spark):
    rnd = random.Random(1)
    pieces = ["MIT", "license", "Apache", "License,", "GENERAL-public", "general", "public", "é", "mit\nlicense", "\x00", "x9", "licenses"]
    rows = ODD + [(100 + k, " ".join(rnd.choice(pieces) for _ in range(rnd.randrange(40)))) for k in range(60)]
    got = license_scan.scan_licenses(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = WORD.findall(low)
        hits = [(k, label) for phrase, label in license_scan.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        want = (len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits})))
        assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want for r in found[i])
        assert all(0 <= r.score <= 1 and set(filter(None, want[4].split(","))) <= set(r.labels.split(",")) for r in found[i])
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text,value",
    [
        ("mit", ({"mit"}, 0)), ("mit or gpl-2.0-only", ({"mit", "gpl"}, 0)), ("mit and gpl-3.0+", ({"mit", "gpl"}, 2)), ("gpl-2.0 with classpath-exception-2.0", ({"gpl"}, 1)),
        ("mit or bsd-3-clause and gpl-2.0", ({"mit", "bsd", "gpl"}, 0)), ("(mit or bsd-3-clause) and gpl-2.0 */", ({"mit", "bsd", "gpl"}, 2)), ("odd-1", ({"odd-1"}, 2)),
        ("mit or", None), ("or mit", None), ("(mit", None), ("mit)", None), ("mit bsd", None), ("", None), ("(mit or isc) with x", None), ("mit $ isc", None),
    ],
)
def test_license_expressions(text, value):
    rpn = license_scan.postfix(text)
    got = rpn and license_scan.evaluate(rpn)
    assert (got and (set(got[0]), got[1])) == value


def test_license_tags(spark):
    text = "/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1 */\nx\nSPDX-License-Identifier: MIT OR\n"
    r = license_scan.scan_licenses(docs(spark, [(1, text)])).first()
    assert (r.labels, r.base_labels, r.obligation, len(r.expressions)) == ("apache,lgpl,mit", "", "weak", 1)


# ---- languages


def test_language_on_held_out_rows(spark):
    rnd = random.Random(2)
    alphabets = {"aa": "abcdeé", "bb": "mnopqö", "cc": "acemoq"}
    rows = [(1000 + k, " ".join("".join(rnd.choice(alphabets[lang]) for _ in range(6)) for _ in range(20)), lang) for k in range(300) for lang in [rnd.choice(sorted(alphabets))]]
    df = spark.createDataFrame(rows + [(i, t, None) for i, t in ODD], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    held = language_ppm.held_out(F.col("doc_id"))
    model = language_ppm.fit(df.where(~held))
    got = {r.doc_id: r for r in language_ppm.identify(df, model).collect()}
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == df.where(f"doc_id = {i}").select(held).first()[0] for i in (1000, 1001, 1002))
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 297
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 4))
    assert got[6].lang_pred in alphabets and 0 < got[6].score <= 1
    nothing = language_ppm.fit(df.where("false"))
    assert {r.lang_pred for r in language_ppm.identify(df, nothing).collect()} == {"und"}
    assert language_ppm.identify(df.where("false"), model).count() == 0


def test_code_lengths_follow_from_the_counts():
    """By hand: one text, one language, method C with exclusion, orders 3 to 0 and equal bytes."""
    import math
    from collections import Counter, defaultdict

    import numpy as np

    text = b"abababac"
    padded = bytes(3) + text
    grams = Counter(padded[k : k + 4] for k in range(len(text)))
    code = np.array([int.from_bytes(g, "big") for g in grams])
    model = language_ppm.build(["x"], np.array(["x"] * len(code)), code, np.array(list(grams.values())), 1000)
    counts = defaultdict(Counter)
    for g, n in grams.items():
        for order in range(4):
            counts[order, g[3 - order : 3]][g[3]] += n

    def bits(context, byte):
        total, used = 0.0, set()
        for order in (3, 2, 1, 0):
            c = {b: n for b, n in counts[order, context[3 - order :]].items() if b not in used}
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if byte in c:
                return total + math.log2(whole / c[byte])
            total += math.log2(whole / len(c))
            used |= set(c)
        return total + math.log2(256 - len(used))

    for probe in (b"abac", b"zzz", b"ba\xffcab"):
        p = bytes(3) + probe
        want = sum(bits(p[k : k + 3], p[k + 3]) for k in range(len(probe)))
        assert model.code_lengths(probe)[0] == pytest.approx(want, rel=1e-4)


# ---- BPE


def _texts(seed, n):
    rnd = random.Random(seed)
    pool = "aab zZ 09!'s\n\té€ß漢字🙂\u2028\x85\x1c,."
    return ["".join(rnd.choice(pool) for _ in range(rnd.randrange(80))) for _ in range(n)] + ["a" * 3000, " " * 500 + "x", "<|endoftext|>"]


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_replay.read_ranks(f), special_tokens={})
    rows = ODD + [(100 + k, t) for k, t in enumerate(_texts(3, 150))]
    got = bpe_replay.encode_documents(docs(spark, rows), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    want = {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        ids = encoding.encode_ordinary(want[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    assert bpe_replay.encode_documents(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_replay_when_a_merge_opens_a_lower_rank():
    """bc ranks below ab, but c only arises after ab would: words replayed alone give the same ids."""
    pieces = [bytes([b]) for b in range(256)] + [b"xyz", b"zz", b"xy", b"yz", b"xyzz"]
    vocabulary = bpe_replay.Vocabulary({p: k for k, p in enumerate(pieces)})
    words = [bytes(random.Random(k).choice(b"xyz") for _ in range(12)) for k in range(200)]
    assert bpe_replay.replay(words, vocabulary) == [bpe_replay.alone(w, vocabulary) for w in words]


def test_token_files_give_back_what_the_library_says(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    added = ["ab <|endoftext|> c", "<|endoftext|><|endoftext|>", "a<|endoftext|> b" * 40, "<|endoftext|", " <|endoftext|>\n\n x's"]
    assert 50256 in tokenizer.encode(added[0], add_special_tokens=False).ids
    rows = [(k, t) for k, t in enumerate(_texts(4, 60) + added)] + [(900, None), (901, ""), (901, ""), (None, "no id")]
    got = token_coder.round_trip(docs(spark, rows), JSON, public_tokenizers.PATTERN).orderBy("start").collect()
    at = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in ordered]
    for r, (_, text) in zip(got, ordered):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        at += len(ids)
    assert token_coder.round_trip(docs(spark, []), JSON, public_tokenizers.PATTERN).count() == 0


def test_frames_round_trip_and_find_damage():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (0, 1, 4096, 4097, 9000):
        for top in (0, 5, 50_256, 2**32 - 1):
            ids = rng.integers(0, top + 1, n, dtype=np.uint64).astype(np.uint32)
            assert (token_coder.decode_frame(token_coder.encode_frame(ids)) == ids).all()
    frame = token_coder.encode_frame(rng.integers(0, 500, 5000).astype(np.uint32))
    for at in (len(frame) // 2, len(frame) - 40):
        broken = bytearray(frame)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            token_coder.decode_frame(bytes(broken))


# ---- pages

URLS = [
    None, "", "no scheme", "http://", "https://Example.NET/en/1", "http://a.b.example.net/en", "http://x.net", "http://x.net/", "ftp://u@sub.EXAMPLE.com:80/de/x?y#z", "http://example.com/de", "http://org/fr/1",
    "http://w.org/fr/?q", "http://notexample.com/de/1", "http://net?x/", "http://h#f/", "a://b://c/d", "http://q.com/p.html?b=1&a=2&utm_x=3", "http://www.q.com/p/?a=2&b=1#top", "http://q.com/p",
]
RULES = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"), url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow")]


def test_url_verdicts(spark):
    rows = [(k, u, "h", 1, 2) for k, u in enumerate(URLS)] + [(0, None, "h", 1, 2), (16, URLS[16], "h", 1, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block int, key int")
    listed = spark.createDataFrame([("q.com/p?a=2&b=1",), ("q.com/p?a=2&b=1",), (None,)], "key string")
    for blocks in (1, 1 << 18):
        got = url_filter.filter_urls(pages, listed, RULES, max_blocks=blocks).collect()
        assert len(got) == len(rows)
        for r in got:
            url = URLS[r.page_id] or ""
            rest = url.split("://", 1)[1] if "://" in url else ""
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = host.lower()
            fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
            rule = max(fits, key=lambda x: len(x.text), default=None)
            assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
            assert r.verdict == (rule.verdict if rule else "block" if r.page_id in (16, 17) else "allow")
    assert url_filter.filter_urls(pages.where("false"), listed, RULES).count() == 0
    assert url_filter.filter_urls(pages, listed.where("false"), RULES).where("verdict = 'block' and rule is null").count() == 0


def test_no_listed_url_is_missed_by_the_filter(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("key"))
    probes = spark.range(6000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("k"), "id")
    got = url_filter.possible(probes, F.col("k"), keys)
    assert got.where("id < 3000 and not possible").count() == 0
    assert got.where("id >= 3000 and possible").count() < 600


def test_plain_text_of_pages():
    page = "<html><head><title>A &amp; B</title><script>var t='</p>';</script></head><body><!-- no > --><p>One<b>two</b><br>three &lt;4&gt;<a href='x?a=1&amp;b'>l</a><p>5 < 6<style>p{}</style><!-- open"
    text, title, hrefs = warc_derive.plain_text(page)
    assert (text, title, hrefs) == ("Onetwo\nthree <4>l\n5 < 6", "A & B", ["x?a=1&b"])
    assert warc_derive.plain_text("<script>never closed <p>x") == ("", None, [])
    assert warc_derive.plain_text("<!--" * 50_000)[0] == ""


def test_derivatives_refer_to_their_source(spark):
    html = "<title>T</title><p>Grüß</p><a href=/z>z</a>"
    rows = [(1, "http://h/a", html, "x"), (2, None, None, "x"), (3, "http://h/b", "", "x"), (1, "http://h/a", html, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, header string")
    sources = warc_derive.responses(pages, "2024-01-01T00:00:00Z")
    out = warc_derive.derivatives(sources).collect()
    assert len(out) == 8 and len({r.record_id for r in out}) == 6
    block = sources.where("page_id = 1").first()
    for r in (r for r in out if r.page_id == 1):
        assert r.refers_to == block["record_id"] and f"WARC-Refers-To: {block['record_id']}\r\n" in r.header
        assert r.source_block_digest == warc_derive.digest(bytes(block["block"])) and r.source_payload_digest == warc_derive.digest(html.encode())
        assert f"Content-Length: {len(r.block)}\r\n" in r.header and r.block_digest == warc_derive.digest(bytes(r.block))
        if r.warc_type == "conversion":
            assert bytes(r.block).decode() == "Grüß\nz"
        else:
            assert b"outlink: http://h/z\r\n" in bytes(r.block) and b"source-content-type: text/html" in bytes(r.block)
    image = spark.createDataFrame([(1, None, "u", None, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nxx"), (2, None, None, None, None)], "page_id long, record_id string, uri string, date string, block binary")
    assert sorted(r.warc_type for r in warc_derive.derivatives(image).collect()) == ["conversion", "metadata", "metadata"]
    assert warc_derive.derivatives(sources.where("false")).count() == 0


def test_repeated_and_folded_source_headers():
    head = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/plain\r\nVia: x,\r\n\t y\r\nSet-Cookie: b=2\r\nContent-Type: image/png\r\n\r\nT"
    made = warc_derive.derive("r", "http://h/", "d", head)
    assert [m["warc_type"] for m in made] == ["metadata", "conversion"]
    fields = [x for x in made[0]["block"].decode().split("\r\n") if x.startswith("source-")]
    assert fields[1:6] == ["source-set-cookie: a=1", "source-content-type: text/plain", "source-via: x, y", "source-set-cookie: b=2", "source-content-type: image/png"]


def _response(body: bytes, *headers: str) -> bytes:
    return "\r\n".join(["HTTP/1.1 200 OK", *headers, "", ""]).encode("latin-1") + body


def _made(block: bytes):
    made = warc_derive.derive("r", "http://h/", "d", block)
    fault = [x[12:] for x in made[0]["block"].decode().split("\r\n") if x.startswith("body-fault: ")]
    assert made[0]["source_payload_digest"] == warc_derive.digest(block.partition(b"\r\n\r\n")[2])
    return (made[1]["block"].decode() if len(made) > 1 else None), (fault or [None])[0]


def test_codings_of_bodies_are_undone():
    page = ("<p>Grüß " + "x y " * 3000 + "</p>").encode()
    text = warc_derive.plain_text(page.decode())[0]
    zipped, chunk = gzip.compress(page), lambda d: b"".join(b"%x;a=b\r\n%s\r\n" % (len(d[k : k + 700]), d[k : k + 700]) for k in range(0, len(d), 700)) + b"0\r\nX: y\r\n\r\n"
    html, gz, ch = "Content-Type: text/html", "Content-Encoding: GZIP", "Transfer-Encoding: chunked"
    raw = zlib.compressobj(wbits=-15)
    bare = raw.compress(page) + raw.flush()
    for body, heads in [
        (page, [html]), (zipped, [html, gz]), (chunk(page), [html, ch]), (chunk(zipped), [html, gz, ch]), (zlib.compress(page), [html, "Content-Encoding: deflate"]), (bare, [html, "Content-Encoding: deflate"]),
        (gzip.compress(page[:50]) + gzip.compress(page[50:]) + b"\0\0", [html, gz]), (gzip.compress(zipped), [html, "Content-Encoding: gzip, x-gzip"]), (page, [html, gz, ch]), (page, [html, "Content-Encoding: identity"]),
    ]:
        assert _made(_response(body, *heads)) == (text, None)
    assert _made(_response(zipped, html, "Content-Encoding: br")) == (None, "content-encoding br")
    assert _made(_response(b"\x1f\x8bnothing", html, gz)) == (None, "content-encoding gzip: broken data")
    cut, fault = _made(_response(zipped[:-20], html, gz))
    assert text.startswith(cut) and fault == "content-encoding gzip: data end early"
    cut, fault = _made(_response(chunk(page)[:1000], html, ch))
    assert text.startswith(cut) and len(cut) > 600 and fault == "transfer-encoding chunked: broken chunk"
    assert _made(_response(b"", html, gz, ch)) == ("", None)


def test_charsets_of_bodies():
    html = "Content-Type: text/html"
    for body, head in [
        ("<meta charset='iso-8859-1'>café".encode("latin-1"), html), ('<meta http-equiv=x content="text/html; charset=windows-1252">café'.encode("cp1252"), html), ("café".encode("latin-1"), html + "; charset=latin1"),
        ("<meta charset=latin1>café".encode(), html + "; charset=utf-8"), ("<meta charset=none-such>café".encode(), html), ("<meta charset=utf-16>café".encode(), html), ("\ufeffcafé".encode(), html), ("\ufeffcafé".encode("utf-16-le"), html),
        ("café".encode(), html + "; charset=hex"),
    ]:
        assert _made(_response(body, head)) == ("café", None)


def test_source_headers_without_value_stay():
    block = warc_derive.derive("r", "u", "d", _response(b"x", "X-Empty:", "Content-Type: text/plain", "X-Empty: ", "no colon"))[0]["block"].decode().split("\r\n")
    assert block[:5] == ["source-status: HTTP/1.1 200 OK", "source-x-empty: ", "source-content-type: text/plain", "source-x-empty: ", "source-no colon: "]
    long = warc_derive.derive(None, None, None, _response(b"x", "Content-Type: text/plain", "Y: " + "z" * 200_000))
    assert f"source-y: {'z' * 200_000}\r\n".encode() in long[0]["block"] and long[1]["block"] == b"x"


class _Reader(html.parser.HTMLParser):
    """Text by another parser, for the brute-force comparison."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.title, self.inside = [], [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in warc_derive.BREAKS:
            self.parts.append("\n")
        if tag in warc_derive.HIDDEN:
            self.inside.append(tag)
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if tag in warc_derive.BREAKS:
            self.parts.append("\n")
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)
        elif self.inside[-1] == "title" and self.title is None:
            self.title = " ".join(data.split())


def test_derivatives_of_all_pages_equal_another_reader(spark, sf):
    from dwellmatch.llm import queries

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()}
    got = queries.queries()["op1_warc_derive"](spark, sf).collect()
    assert len(got) == 2 * len(pages) and len({r.record_id for r in got}) == len(got)
    ids = {(r.page_id, r.warc_type): r.record_id for r in got}
    for r in got:
        reader = _Reader()
        reader.feed(pages[r.page_id].html or "")
        reader.close()
        body = (pages[r.page_id].html or "").encode()
        assert r.source_payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        other = ids[(r.page_id, "metadata" if r.warc_type == "conversion" else "conversion")]
        assert f"WARC-Concurrent-To: {other}\r\n" in r.header and f"WARC-Refers-To: {r.refers_to}\r\n" in r.header
        if r.warc_type == "conversion":
            lines = (" ".join(x.split()) for x in "".join(reader.parts).split("\n"))
            assert bytes(r.block).decode() == "\n".join(x for x in lines if x)
        else:
            fields = bytes(r.block).decode().split("\r\n")
            assert [x[9:] for x in fields if x.startswith("outlink: ")] == [urljoin(pages[r.page_id].url or "", x) for x in reader.links]
            assert [x[7:] for x in fields if x.startswith("title: ")] == ([reader.title] if reader.title else [])
