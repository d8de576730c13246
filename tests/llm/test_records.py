"""Archives, media, pages, packing and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import re
import struct
import time
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rasterloom.llm import html_text, media, mixing, packing, shared, toxicity, warc

from .helpers import components, no_docs, odd_docs, odd_rows
from .test_documents import brute_lines, brute_mix, shingles, slow_logit

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

# --- WARC

PAGES = "page_id long, url string, html string, digest string, payload string, uri string"


def page_rows():
    big, other = "<p>" + "x" * 1000, "é" * 600
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (3, None, big), (4, "http://c/", "small"), (5, "u", "small"), (6, "u\r\nx: y", None), (7, "u", ""), (8, "u", other), (9, "u", other), (None, "u", big)]
    rows += [(100 + n, "http://many/", f"page {n % 3} " + "text " * 300) for n in range(200)]
    return [(*r, "x", "x", "x") for r in rows]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(6)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", roll=40_000)
    records = shared.write(warc.read_archives(archives, f"file://{tmp_path}/w", with_payload=True), "records")
    got = sorted((tuple(r) for r in warc.resolved(records).collect()), key=repr)
    want, tops = [], {}
    for page, _, html, *_ in page_rows():
        if page is not None:
            tops[html] = max(tops.get(html, page), page)
    seen = set()
    for page, _, html, *_ in page_rows():
        data = (html or "").encode()
        revisit = len(data) >= 1000 and page is not None and (page != tops[html] or (page, html) in seen)
        seen.add((page, html))
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", tops[html] if revisit else None))
    assert got == sorted(want, key=repr)
    assert len(list((tmp_path / "w").glob("*.warc.zst"))) > 1
    payloads = {r["page_id"]: bytes(r["payload"]) for r in records.where("record_type = 'response' and page_id = 9").collect()}
    assert payloads == {9: ("é" * 600).encode()}
    empty = warc.write_archives(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e")
    assert warc.read_archives(empty, f"file://{tmp_path}/e").count() == 0


def archive(n=100, **changes):
    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    writer = warc.ArchiveWriter(out, sample=32)
    for i in range(n):
        data = f"<html>record {i} of the archive, with some text {i * i}</html>".encode() * 3
        writer.add(warc.record_bytes("response", i, f"http://host/{i}", data, hashlib.sha1(data).hexdigest(), None, "2020-01-01T00:00:00Z"))
    writer.close()
    return out.getvalue()


def test_archive_layout_and_broken_archives():
    data = archive()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE and size > 0
    records = list(warc.read_archive(io.BytesIO(data)))
    assert [h["x-page-id"] for _, h, _ in records] == [str(i) for i in range(100)]
    for offset, _, _ in records:  # one frame a record, its size declared
        assert zstandard.get_frame_parameters(data[offset:]).content_size > 0
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + data[8 + size :]
    assert len(list(warc.read_archive(io.BytesIO(again)))) == 100
    assert len(list(warc.read_archive(io.BytesIO(archive(3))))) == 3  # too few for a dictionary
    for broken in (b"", b"WARC/1.1\r\n", data[:100], data[:-3], data[:-40] + b"\0" * 40, data[8 + size :]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(broken)))


def other_records() -> list[bytes]:
    """Records as other writers make them."""
    def record(kind, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in more.items()}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    body = b"<html>hello</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"7\r\n<html>h\r\nb\r\nello</html>\r\n0\r\n\r\n"
    base32 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    kind = "application/http; msgtype=response"
    return [
        record("warcinfo", b"software: other\r\n", Content_Type="application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request", WARC_Target_URI="http://o/"),
        record("response", http + body, Content_Type=kind, WARC_Target_URI="http://o/", WARC_Payload_Digest=f"sha1:{base32}", WARC_Block_Digest="sha256:" + hashlib.sha256(http + body).hexdigest()),
        record("response", chunked, Content_Type=kind, WARC_Payload_Digest=f"SHA-1:{base32.lower()}"),
        record("response", body, Content_Type="text/html"),
        record("resource", body, WARC_Payload_Digest="blake9:123"),
        record("metadata", b"", X_Page_ID="seven"),
        record("revisit", http, Content_Type=kind, WARC_Payload_Digest=f"sha1:{base32}", WARC_Refers_To="<urn:response>"),
        record("response", body[:5], WARC_Payload_Digest=f"sha1:{base32}", WARC_Truncated="length"),
    ]


def test_archives_of_others(spark, tmp_path):
    body = b"<html>hello</html>"
    frames = [zstandard.ZstdCompressor().compress(r) for r in other_records()]
    frames.insert(3, struct.pack("<II", 0x184D2A50, 4) + b"skip")
    (tmp_path / "o.warc.zst").write_bytes(b"".join(frames))
    (tmp_path / "p.warc.zst").write_bytes(struct.pack("<II", warc.SKIPPABLE, 0) + zstandard.ZstdCompressor(write_content_size=False).compress(b"".join(other_records()[:1])))
    listed = spark.createDataFrame([(f"{tmp_path}/{x}.warc.zst", None) for x in "op"], warc.LIST)
    rows = sorted(warc.read_archives(listed, f"file://{tmp_path}", with_payload=True).collect(), key=lambda r: (r["record_type"], r["payload"]))
    hexed = hashlib.sha1(body).hexdigest()
    assert [r["record_type"] for r in rows] == ["metadata", "request", "resource", *["response"] * 4, "revisit", "warcinfo", "warcinfo"]
    got = {bytes(r["payload"]): r["payload_digest"] for r in rows if r["record_type"] == "response"}
    assert got[body] == hexed and len(got) == 3 and set(got.values()) == {hexed}
    revisit = rows[7]
    assert (revisit["payload_digest"], revisit["refers_to_record"], revisit["page_id"]) == (hexed, "<urn:response>", None)
    assert rows[2]["payload_digest"] == hexed and rows[0]["page_id"] is None
    wrong = other_records()[2].replace(b"hello", b"hullo"), other_records()[3].replace(b"ello", b"ullo"), other_records()[0].replace(b"warcinfo", b"nonsense")
    for data in (*wrong, other_records()[2].replace(b"sha1:", b"sha1:1")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(data)


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(6)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", roll=20_000)
    records = warc.read_archives(archives, f"file://{tmp_path}/w")
    tasks = [r["n"] for r in records.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert archives.count() >= 6 and len(tasks) >= archives.count() // 2 and sum(tasks) == len(page_rows())
    revisit = records.where("record_type = 'revisit'").select("refers_to_record").distinct()
    assert revisit.join(records.select(F.col("record_id").alias("refers_to_record")), "refers_to_record").count() == revisit.count() > 0
    assert records.select("record_id").distinct().count() == len(page_rows())


def test_broken_records():
    good = warc.record_bytes("response", 1, "http://h/", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2020-01-01T00:00:00Z")
    assert warc.parse_record(good)[1] == b"payload"
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), good.replace(b"Content-Length: 7", b"Content-Length: x"), good[:-2],
        good.replace(b"WARC-Date", b"X-Date"), good.replace(b"payload", b"PAYLOAD"), good.replace(b"WARC-Type: response", b"WARC-Type: revisit"), good.replace(b"\r\n\r\n", b"\r\n", 1), good.replace(b"WARC-Type:", b"WARC-Type"),
    ):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


# --- media


def png(w=2, h=2):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0\0" * h)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
BMP = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
PGM = b"P5 3 2 255\n" + b"abcdef"
AU = b".snd" + struct.pack(">IIIII", 24, 4, 2, 8000, 1) + b"data"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab\xff\xc0" + struct.pack(">H", 4) + b"cd\xff\xda" + struct.pack(">H", 4) + b"ef\x01\xff\x00\x02\xff\xd9"
OGG = b"OggS\0\x06" + b"\0" * 8 + struct.pack("<III", 5, 0, 0) + b"\x01\x03abc"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
SAMPLES = {"audio/wav": media.wav_of(b"\x80" * 576), "image/png": png(), "image/gif": GIF, "image/bmp": BMP, "image/x-portable-graymap": PGM, "audio/basic": AU, "image/jpeg": JPEG, "audio/ogg": OGG, "application/pdf": PDF, "application/gzip": gzip.compress(b"zip me")}


@pytest.mark.parametrize("mime", sorted(SAMPLES))
def test_formats(mime):
    data = SAMPLES[mime]
    assert media.found_media(data) == [(0, len(data), mime)]
    assert (5, len(data), mime) in media.found_media(b"junk " + data + b" BM GIF89a RIFF")
    assert media.found_media(data[:-1]) == [] or mime == "application/pdf"


def test_false_magic_and_carving():
    assert media.found_media(b"BMW drives RIFF raff P5 and GIF89a, .snd of \xff\xd8\xff") == []
    data = SAMPLES["audio/wav"] + b"--" + png() + b"--" + GIF
    at = len(SAMPLES["audio/wav"]) + 2
    assert media.found_media(data) == [(0, at - 2, "audio/wav"), (at, len(png()), "image/png"), (at + len(png()) + 2, len(GIF), "image/gif")]


def riff(form: bytes, *chunks: tuple[bytes, bytes]) -> bytes:
    body = form + b"".join(name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2) for name, data in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", 8 + len(data)) + name + data


def zipped(note: bytes = b"") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "text " * 50)
        z.writestr("b.png", png())
        z.comment = note
    return out.getvalue()


MORE = {
    "image/webp": [riff(b"WEBP", (b"VP8 ", b"abc")), riff(b"WEBP", (b"VP8X", b"\0" * 10), (b"VP8L", b"ab"))],
    "video/x-msvideo": [riff(b"AVI ", (b"LIST", b"hdrl" + b"\0" * 8), (b"LIST", b"movi" + b"\1" * 9))],
    "application/zip": [zipped(), zipped(b"a note"), b"PK\x05\x06" + b"\0" * 18],
    "video/mp4": [box(b"ftyp", b"isom\0\0\0\0mp42") + box(b"moov", b"m" * 9) + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 21) + b"d" * 5],
    "application/gzip": [gzip.compress(b"text" * 100), b"\x1f\x8b\x08\x18" + b"\0" * 6 + b"name\0note\0" + gzip.compress(b"text")[10:]],
}


@pytest.mark.parametrize("mime", sorted(MORE))
def test_more_formats(mime):
    for data in MORE[mime]:
        assert media.found_media(data) == [(0, len(data), mime)]
        assert media.found_media(b"junk " + data + b" PK\x05\x06 WEBP") == [(5, len(data), mime)]
        assert media.found_media(data[:-1]) == []
    assert media.found_media(MORE[mime][0] + png()) == [(0, len(MORE[mime][0]), mime), (len(MORE[mime][0]), len(png()), "image/png")]


def test_flac_lasts_until_the_end():
    data = b"fLaC\0\0\0\x22" + b"i" * 34 + b"\x84\0\0\x03abc" + b"\xff\xf8frames"
    assert media.found_media(data) == [(0, len(data), "audio/flac")] and media.found_media(data[:50]) == []
    assert media.found_media(png() + data) == [(0, len(png()), "image/png"), (len(png()), len(data), "audio/flac")]


@pytest.mark.parametrize(
    "unit",
    [
        b"P5 1 1 9 x", b"RIFF", b"RIFF\x10\0\0\0WAVE", b"GIF89a", b"GIF89a\0\0\0\0\0\0\0!\xf9\x01a", b"\xff\xd8\xff", b"\xff\xd8\xff\xda\0\x02", b"\x1f\x8b\x08", b"%PDF-1.4 startxref %%EOF",
        b"PK\x03\x04", b"PK\x05\x06", b"\0\0\0\x10ftypisom\0\0\0\0", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR",
    ],
)
def test_repeated_magic_takes_linear_time(unit):
    data = unit * (2_000_000 // len(unit))
    start = time.perf_counter()
    media.found_media(data)
    assert time.perf_counter() - start < 20


def test_carving_against_all_hits():
    """Random concatenations of media and junk against a search that tries every place in turn."""
    rng = np.random.default_rng(5)
    parts = [*SAMPLES.values(), *(x for own in MORE.values() for x in own), b"junk", b"BM", b"RIFF", b"\xff\xd8\xff", b"P5 1 1 "]
    for _ in range(60):
        data = b"".join(parts[i] for i in rng.integers(0, len(parts), 7))
        data = data[: rng.integers(1, len(data))]
        want, at = [], 0
        while at < len(data):
            lengths = [(f.check(media.Value(data), at) or 0, -i) for i, f in enumerate(media.FORMATS) if data[at + f.offset :].startswith(f.magic)]
            length, i = max(lengths, default=(0, 0))
            if length:
                want.append((at, length, media.FORMATS[-i].mime))
            at += length or 1
        assert media.found_media(data) == want


def test_media_columns(spark):
    rows = [(1, "image/png", GIF), (2, "image/gif", GIF), (3, None, b""), (4, "text/plain", None), (5, "text/plain", b"text" + png()), (5, "text/plain", b"text" + png())]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "id long, declared string, media binary, media_type string, carved string")
    got = media.sniff(df, declared_col="declared", carry=("id",)).collect()
    assert sorted((r["id"], r["media_type"], r["type_corrected"], len(r["carved"])) for r in got if r["id"] != 4) == [
        (1, "image/gif", True, 0), (2, "image/gif", False, 0), (3, media.UNKNOWN, True, 0), (5, media.UNKNOWN, True, 1), (5, media.UNKNOWN, True, 1)]
    assert [(r["media_type"], r["type_corrected"]) for r in got if r["id"] == 4] == [(None, False)]
    assert media.sniff(df.where("false")).count() == 0


def test_stored_texts(spark):
    got = media.wav_features(media.sniff(media.store_texts(odd_docs(spark)), declared_col="declared", carry=("doc_id", "n_bytes"))).collect()
    want = []
    for i, text, *_ in odd_rows():
        raw = (text or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        stored = media.wav_of(full)
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(full)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert media.wav_features(media.sniff(media.store_texts(no_docs(spark)), declared_col="declared", carry=("doc_id", "n_bytes"))).count() == 0


# --- pages


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("just text &amp; more&nbsp; text", "just text & more text"),
        ("<nav>n</nav><article><h1>T</h1><p>one<br>two <b>bo</b>ld<p>three</article><footer>f</footer>", "T\n\none two bold\n\nthree"),
        ("<body><div class='sidebar'>s</div><div id=content><p>a</p>b<ul><li>c<li>d</ul></div><div class='cookie-notice'>x</div></body>", "a\n\nb\n\nc\n\nd"),
        ("<article><p>a<script>if (x < 1) { '</p>' }</script>b<style>p{}</style></p><form>q<input></form><div class=comments><p>c</div></article>", "ab"),
        ("<article>a</article><article class=comment>b</article><article>c</article>", "a\n\nc"),
        ("<header>h</header><main><header><h1>T</h1></header>t</main>", "T\n\nt"),
        ("<article>a &lt;b&gt; &#233; &copy 3 < 4</article>", "a <b> é © 3 < 4"),
        ("<!-- <article>no</article> --><article title='a>b'>yes<!-- c --></article", "yes"),
        ("<div class=ad><article>inside</article></div>", "inside"),
        ("<article>" + "<div>" * 3000 + "deep", "deep"),
        ("<article><p>x</p><aside>y</aside><div hidden>z</div><p style='display: none'>w</p></article>", "x"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        *((f"<body><div id=page class='{c}'><p>story</p><div class=ad>x</div></div></body>", "story") for c in ("content no-sidebar", "has-banner", "header-fixed", "related-layout", "menu")),
        ("<article><p>one</p><section class=discussion>two</section><h2 class=section-header>three</h2><div class=form-factor>four</div><div class=share>x</div></article>", "one\n\ntwo\n\nthree\n\nfour"),
        ("<article><div class=related-layout><p>long enough</p></div><p>end</p></article>", "long enough\n\nend"),
        ("<article class='post tag-social'>a long story</article><article class=comment>b</article>", "a long story"),
        ("<div><p>short</p></div><div class=comments><p>a long talk about it</p></div>", "short"),
        ("<body><div class=alert>closed</div><div class=notice>opened</div></body>", "closed\n\nopened"),
        ("<body><nav>n</nav><div class=widget>only text</div></body>", "only text"),
        ("<main>a<div role=main>b</div></main><p>x</p><div><main>c</main></div><div role=main>d</div>", "a\n\nb\n\nc\n\nd"),
    ],
)
def test_names_alone_take_no_main_text(page, want):
    assert html_text.main_text(page) == want


def test_site_style_tree(spark):
    """A host whose furniture has no telling names is learned from its pages; a small host is left to structure."""
    def page(n, host):
        return f"<html><body><div><span>Welcome to {host}</span></div><section><p>story {n} is about {n * n}</p><p>and {n + 1}</p></section><div><em>call us</em></div></body></html>"

    rows = [(n, f"https://big.example/{n}", page(n, "us")) for n in range(40)] + [(100 + n, "http://user@Small.example:80/x", page(n, "them")) for n in range(2)]
    rows += [(5, "https://big.example/5", page(5, "us")), (None, None, None), (200, "https://big.example/low", "<body><div><span>Welcome to us</span></div></body>")]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, text string, low string").repartition(5)
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[n] == f"story {n} is about {n * n}\n\nand {n + 1}" for n in range(40))
    assert text[100].startswith("Welcome to them\n\nstory 0") and text[None] == "" and text[200] == "Welcome to us"
    assert html_text.extract(pages.where("false")).count() == 0


def test_titles_of_near_copies_stay(spark):
    """Most of a host's pages are near copies with one title: it is no furniture in articles, and other titles never are."""
    def page(n, tag):
        title = "one title" if n < 90 else f"title {n}"
        return f"<html><body><div><em>call us</em></div><{tag}><h1>{title}</h1><p>text {n}</p></{tag}></body></html>"

    rows = [(n, f"https://a.example/{n}", page(n, "article")) for n in range(100)] + [(1000 + n, f"https://b.example/{n}", page(n, "section")) for n in range(100)]
    text = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(text[n] == f"{'one title' if n < 90 else f'title {n}'}\n\ntext {n}" for n in range(100))
    assert all(text[1000 + n] == f"title {n}\n\ntext {n}" for n in range(90, 100))
    assert all(text[1000 + n] == f"text {n}" for n in range(90))


def unnamed_page(n: int) -> str:
    """Furniture without telling tags or names around a short story; one part of it varies a little."""
    return (
        f"<html><body><div class=a1><span>Welcome to the paper of the town</span><b>day {n % 3}</b></div><section class=a2><p>story {n} is about {n * n}</p><p>and {n + 1}</p></section>"
        f"<div class=a3><div>Call our desk at any hour</div><em>all words are ours</em><i>{n}</i></div></body></html>"
    )


def test_the_tree_decides_on_every_page(spark):
    rows = [(n, f"https://{'big' if n % 3 else 'other'}.example/{n}", unnamed_page(n)) for n in range(60)]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, host string, keys string").repartition(5)
    text = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for n, _, html in rows:
        assert text[n] == f"story {n} is about {n * n}\n\nand {n + 1}" != html_text.main_text(html)


def test_importance_by_its_definition(spark):
    """Entropies of contents and of presentations against sums over explicit shares."""
    htmls = [unnamed_page(n) for n in range(30)] + [unnamed_page(n).replace("<section", "<p>extra</p><section") for n in range(30, 40)]
    pages = spark.createDataFrame([(n, "http://h.example/", h) for n, h in enumerate([*htmls, htmls[0]])], "page_id long, url string, html string")
    got = {(r["kind"], r["key"] & html_text.MASK): (r["n_pages"], r["importance"]) for r in html_text.importance(pages, least_pages=8).collect()}
    texts, styles = {}, {}
    for page, html in enumerate(htmls):
        stack = [html_text.parse(html)]
        while stack:
            x = stack.pop()
            kinds = tuple(c.path for c in x.children if not isinstance(c, str))
            styles.setdefault(x.path, {}).setdefault(page, []).append(tuple(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]))
            for c in x.children:
                if not isinstance(c, str):
                    stack.append(c)
                elif c.strip():
                    texts.setdefault((x.path, c), set()).add(page)
    want = {}
    for path, by_page in styles.items():
        m = len(by_page)
        seen = [repr(v) for v in by_page.values()]
        shares = [seen.count(v) / m for v in set(seen)]
        if m >= 8:
            want[html_text.STYLE, path] = (m, -sum(p * math.log(p, m) for p in shares))
    for (path, text), own in texts.items():
        m, n = len(styles[path]), len(own)
        if m >= 8 and n > 1:
            want[html_text.CONTENT, html_text.content_key(path, text)] = (n, 1 + sum(1 / n * math.log(1 / n, m) for _ in own))
    assert set(got) == set(want) and len({v[1] for v in want.values()}) > 4
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_articles_that_are_not_the_page_s(spark):
    for page, want in [
        ("<article>story<div class='comments'><article class='comment'><p>reader says hi</article></div></article>", "story"),
        ("<article>story</article><aside class='related'><article>Teaser, a long one at that</article></aside>", "story"),
        ("<article>a main story<h2 class='header'>Chapter one</h2><p class=form>The form of verse</p></article><div class=related><article>Teaser</article></div>", "a main story\n\nChapter one\n\nThe form of verse"),
        ("<form id=all><nav>n</nav><main>text</main></form>", "text"),
        ("<article><p>x <math><mi>y</mi></math> <label>z</label></p><form><label>q</label></form></article>", "x y z"),
        ("<article>deep<article class='reply comment'>answer</article></article>", "deep"),
    ]:
        assert html_text.main_text(page) == want
    teaser = "<section><article><p>Read the story of the year</p></article></section>"
    rows = [(n, "http://t.example/", f"<body><article><p>story {n} of {n * n}</p></article>{teaser}</body>") for n in range(20)]
    text = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[n] == f"story {n} of {n * n}" for n in range(20))


@pytest.mark.parametrize(
    "page",
    [
        "<span>" * 100_000 + "x" + "</b>" * 100_000, "<div class=ad>" * 100_000 + "x", "<article>" * 100_000 + "x", "<ul>" + "<span>" * 50_000 + "<li>a" * 50_000,
        "<p><td>" + "<span>" * 50_000 + "<ul></ul>" * 50_000 + "x", "<div><p class=ad>a</p><p>b</p></div>" * 30_000,
    ],
)
def test_large_pages_take_linear_time(page):
    """A walk over ancestors or descendants for each node would take minutes."""
    start = time.perf_counter()
    assert html_text.main_text(page)
    html_text.features(html_text.parse(page))
    assert time.perf_counter() - start < 30


# --- packing


def brute_ids():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in odd_rows()]


def check_packed(rows, want, capacity):
    """rows: (doc_id, start, length, doc_tokens, ids, sequence_id, offset); want: (doc_id, ids) of each document."""
    sequences, pieces = {}, []
    for doc, start, length, total, ids, sequence, offset in rows:
        ids = np.frombuffer(ids, "<u4").tolist()
        assert len(ids) == length <= capacity
        sequences.setdefault(sequence, []).append((offset, length))
        pieces.append((doc, start, total, ids))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    expected = [(doc, s, len(ids), ids[s : s + capacity]) for doc, ids in want for s in range(0, len(ids), capacity)]
    assert sorted(pieces, key=repr) == sorted(expected, key=repr)
    return sequences


def test_packing_of_odd_rows(spark):
    packed = packing.pack(odd_docs(spark), VOCABULARY, capacity=256)
    rows = packed.select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset").collect()
    sequences = check_packed([tuple(r) for r in rows], brute_ids(), 256)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(packed, 256, pad_id=9).collect()}
    assert whole.keys() == sequences.keys()
    for sequence, own in sequences.items():
        used = sum(n for _, n in own)
        assert len(whole[sequence]) == (used if used & (used - 1) == 0 else 256) and (whole[sequence][used:] == 9).all()
    assert packing.pack(no_docs(spark), VOCABULARY).count() == 0


def test_packing_leaves_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.place(shared.write(packing.token_pieces(docs, VOCABULARY).drop("ids"), "pieces"))
    row = pieces.agg(F.sum("length").alias("used"), F.countDistinct("sequence_id").alias("n")).first()
    assert row["used"] / row["n"] / 2048 > 0.98


def test_patterns_cover_the_demand():
    rng = np.random.default_rng(4)
    for demand in (rng.integers(0, 500, 65), np.eye(65, dtype=int)[64] * 9, np.zeros(65, int), (rng.random(65) < 0.1) * rng.integers(1, 90_000, 65), np.array([0] + [1] * 64)):
        demand[0] = 0
        patterns, used = packing.cutting_stock(demand, 64)
        assert ((patterns * used[:, None]).sum(axis=0) == demand).all() and (patterns @ np.arange(65) <= 64).all()
        least = -(-(demand * np.arange(65)).sum() // 64)
        halves = demand[33:].sum()  # wider than half: one a sequence
        assert used.sum() <= max(least, halves) * 1.06 + 3


def test_word_by_word_ids_are_the_text_s():
    rng = np.random.default_rng(6)
    letters = [*"abcXYZ àéÉßªºµÿ×÷ \n\t,.!-_0123½ \xa0\x85\x1c\u0107İΣσςΑ漢字\u0301\u200dSt", "'", " ", "<|endoftext|>", "'s ", "'Re", " ,.", "hello, world. "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.integers(0, 30))) for _ in range(3000)] + [None, ""]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (10, 100_000):
        words = packing.WordIds(VOCABULARY, most)
        got = [ids.tolist() for at in range(0, len(texts), 100) for ids in words.encode(texts[at : at + 100])]
        assert got == want


# --- pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("x") for c in ("score", "kept", "n_lines", "component_id", "epoch")})
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = shared.write(stage(spark, docs, sf), name)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        before, left = docs.count(), after.count()
        assert 0 < left <= before and (name != "line_dedup" or left == before)
        docs = after
    packed = corpus_pipeline.pack_sequences(spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_against_brute_force(spark):
    """Each stage on what its predecessor kept, against plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    after = shared.write(corpus_pipeline.drop_toxic(spark, docs, sf), "t")
    want = [r for r in rows if (slow_logit(model, r[1]) if len(r[1]) < 4000 else float(np.log(1 / (1 / toxicity.Scorer(model)([r[1]])[0] - 1)))) < 0]
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == sorted(r[:2] for r in want) and len(want) < len(rows)

    docs, rows = after, want
    after = shared.write(corpus_pipeline.drop_lines(spark, docs, sf), "l")
    lines = {i: text for i, _, _, text in brute_lines([r[:2] for r in rows])}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()} == {i: (t, len(t)) for i, t in lines.items()}
    assert any(lines[r[0]] != r[1] for r in rows)

    docs, rows = after, [(r[0], lines[r[0]], *r[2:]) for r in rows]
    after = shared.write(corpus_pipeline.drop_near_copies(spark, docs, sf), "n")
    sets = {r[0]: shingles(r[1], 5) for r in rows}
    groups = components(sorted(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    want = [r for r in rows if groups[r[0]] == r[0]]
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == sorted(r[:2] for r in want) and len(want) < len(rows)

    docs, rows = after, want
    after = shared.write(corpus_pipeline.draw_mix(spark, docs, sf), "m")
    named = {r["doc_id"]: (r["domain"], r["lang"], r["source"]) for r in mixing.leaves_of(docs, mixing.PRODUCTION, mixing.by_number(F.col("source")), "doc_id", "text", None).collect()}
    keys = {(r["e"], r["doc_id"]): r["k"] for e in (0, 1) for r in docs.select("doc_id", F.lit(e).alias("e"), mixing.order_key(17, F.lit(e), F.col("doc_id")).alias("k")).collect()}
    drawn = brute_mix([(r[0], r[0], named[r[0]], len(re.findall(r"\S+", r[1], re.ASCII))) for r in rows], mixing.PRODUCTION, 0.9, 1, 17, keys)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, _, _ in drawn) and len(drawn) < len(rows)

    kept = {i for i, _, _ in drawn}
    pieces = corpus_pipeline.pack_sequences(spark, after, sf).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = {r[0]: tokenizer.encode(r[1], add_special_tokens=False).ids + [1] for r in rows if r[0] in kept}
    assert {p["doc_id"] for p in pieces} == kept
    for doc, own in ids.items():
        parts = sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces if p["doc_id"] == doc)
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) == len(own) == parts[0][3]
        assert all(zlib.crc32(np.array(own[a : a + n], "<u4").tobytes()) == crc for a, n, crc, _ in parts)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in by_sequence.values():
        own.sort()
        assert [x for x, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_rows_without_ids_and_of_one_id_in_the_pipeline(spark):
    """30,000 rows without an id pass the stages, and of 30,000 rows of one id one stays, whatever else they hold."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("some words of row"), F.col("id"), F.col("id") * 3, F.col("id") * 7).alias("text"),
        F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.create_map(F.lit("k"), F.col("id")).alias("extra"),
    )
    out = corpus_pipeline.drop_near_copies(spark, rows, "").collect()
    assert sum(r["doc_id"] is None for r in out) == 30_000 and [r["text"] for r in out if r["doc_id"] == 7] == [min(f"some words of row {i} {3 * i} {7 * i}" for i in range(0, 60_000, 2))]
    drawn = corpus_pipeline.draw_mix(spark, rows, "")
    assert drawn.columns == rows.columns and 0.9 * 60_000 <= drawn.count() < 0.9 * 60_000 + 40_000


def test_pipeline_of_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.write(stage(spark, docs, sf), name)
        assert docs.count() == 0


def test_near_copies_stage_keeps_one_of_each(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words here"), (3, "other words here"), (None, "other words here"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0 for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()))
    assert kept == [0, 1, 3, 4]
