"""Media codecs and page extraction."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import media, pages


def test_netpbm_kinds():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    rgb = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    assert (media.decode(media.encode_netpbm(grey)) == grey).all() and (media.decode(media.encode_netpbm(rgb)) == rgb).all()
    assert media.decode(b"P2\n# note\n2 2\n255\n1 2\n3 4\n").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P3 1 1 255 7 8 9").tolist() == [[[7, 8, 9]]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 1 65535 \x01\x02").tolist() == [[258]]
    assert media.decode(b"P2 3 1 15 0 7 15").tolist() == [[0, 119, 255]] and media.decode(b"P5 2 1 3 \x01\x09").tolist() == [[85, 255]]
    assert media.decode(b"P2 2 1 1000 500 1000").tolist() == [[32768, 65535]]


def test_bmp_kinds():
    rgb = np.random.default_rng(0).integers(0, 256, (5, 3, 3), dtype=np.uint8)
    data = media.encode_bmp(rgb)
    assert (media.decode(data) == rgb).all()
    top_down = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 58, 0, 0, 54, 40, 1, -1, 1, 32, 0, 4, 0, 0, 0, 0) + bytes([3, 2, 1, 0])
    assert media.decode(top_down).tolist() == [[[1, 2, 3]]]
    palette = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 70, 0, 0, 62, 40, 1, 1, 1, 8, 0, 4, 0, 0, 2, 0) + bytes([0, 0, 0, 0, 30, 20, 10, 0]) + bytes([1, 0, 0, 0])
    assert media.decode(palette).tolist() == [[[10, 20, 30]]]


def test_bmp_bit_fields():
    def bmp(bits, packing, masks, pixels):
        return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + len(masks), 40, 1, 1, 1, bits, packing, 0, 0, 0, 0, 0) + masks + pixels

    red_last = bmp(32, 3, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000), bytes([1, 2, 3, 0]))
    assert media.decode(red_last).tolist() == [[[1, 2, 3]]]
    assert media.decode(bmp(16, 0, b"", struct.pack("<HH", 0x7C00 | 0x1F, 0))).tolist() == [[[255, 0, 255]]]
    assert media.decode(bmp(16, 3, struct.pack("<III", 0xF800, 0x7E0, 0x1F), struct.pack("<HH", 0x07E0, 0))).tolist() == [[[0, 255, 0]]]


def test_area_resize_by_strips_and_in_colour():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 256, (50, 24, 3)).astype(np.uint8)
    grey = media.luminance(a)
    fine = np.repeat(np.repeat(grey, 72, 0), 72, 1)
    want = fine.reshape(8, fine.shape[0] // 8, 9, fine.shape[1] // 9).mean(axis=(1, 3))
    for strip in (1, 7, 4096):
        assert np.allclose(media.area_resize(a, 8, 9, strip), want)
    bits = np.round(want, 6)
    assert media.difference_hash(a) == "".join(f"{int(''.join('01'[int(x < y)] for x, y in zip(r, r[1:])), 2):02x}" for r in bits.tolist())


def test_area_resize_is_the_mean_of_covered_area():
    rng = np.random.default_rng(1)
    for h, w in ((16, 18), (5, 7), (1, 1), (8, 9), (100, 24)):
        a = rng.integers(0, 256, (h, w)).astype(float)
        fine = np.repeat(np.repeat(a, 72, 0), 72, 1)  # 8 and 9 divide 72
        want = fine.reshape(8, fine.shape[0] // 8, 9, fine.shape[1] // 9).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(a, 8, 9), want)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=4000))
def test_payload_round_trip(text):
    payload, n = media.payload_of(text)
    pixels = media.from_tiles(media.to_tiles(media.decode(media.media_of(payload)), 16))
    assert pixels.tobytes() == payload and len(payload) % 576 == 0 and payload and payload[:n] == text.encode() and set(payload[n:]) <= {255}


def plain_hash(pixels):
    """The difference hash with every area mean summed pixel by pixel."""
    grey = media.luminance(pixels).astype(float)
    h, w = grey.shape
    means = np.zeros((8, 9))
    for i in range(8):
        for j in range(9):
            top, bottom, left, right = i * h / 8, (i + 1) * h / 8, j * w / 9, (j + 1) * w / 9
            ys = np.clip(np.minimum(np.arange(h) + 1, bottom) - np.maximum(np.arange(h), top), 0, 1)
            xs = np.clip(np.minimum(np.arange(w) + 1, right) - np.maximum(np.arange(w), left), 0, 1)
            means[i, j] = ys @ grey @ xs / (h / 8 * w / 9)
    means = np.round(means, 6)
    return np.packbits(means[:, :-1] < means[:, 1:]).tobytes().hex()


def test_features_of_documents(rows):
    texts = [None, "", "a", "b" * 576, "c" * 577, "é" * 5000, "a"]
    docs = rows("doc_id long, text string, media string", *[(k, t, "clash") for k, t in enumerate(texts)], (None, "x", None))
    got = {r.doc_id: r for r in media.features(media.tile_media(media.text_media(docs))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.feature == plain_hash(media.from_tiles(media.to_tiles(media.decode(media.media_of(payload)))))
    assert got[2].media_sha256 == got[6].media_sha256 and None in got
    assert media.tile_media(media.text_media(docs.where(F.lit(False)))).count() == 0


def test_broken_media_say_why(rows):
    broken = [b"P5 99999999999999999999 1 255 x", b"P2 1 1 255 99999999999999999999", b"P5 0 4 255 ", b"P5 1 1 0 x", b"P", b"P5 4000000000 4000000000 255 x", media.encode_bmp(np.zeros((1, 1, 3), np.uint8))[:18] + bytes(20)]
    m = rows("id long, media binary", (1, b"GIF89a"), (2, None), (3, b"BM"), (4, b"P5 9 9 255 x"), *[(9 + k, b) for k, b in enumerate(broken)])
    got = {r.id: r.media_error for r in media.tile_media(m).collect()}
    assert all(got.values()) and got[2] == "no media"
    assert media.features(media.tile_media(m)).where("feature is null").count() == 4 + len(broken)


PROSE = "Some words, and more of them, in a row. " * 4


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p></p>", ""), ("<script>var a = '<p>';</script>", ""), ("<title>t</title>", ""),
        (f"<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>T</h1><p>{PROSE}</p><p>End &amp; out&nbsp;.</article><footer>&copy;</footer>", f"T\n\n{PROSE.strip()}\n\nEnd & out ."),
        (f"<div class=content><h2>T</h2><p>{PROSE}<p>short<br>line<div class='cookie-notice'>x</div></div><div id=sidebar><p>{PROSE}</p></div>", f"T\n\n{PROSE.strip()}\n\nshort line"),
        (f"<main><p>{PROSE}</p><section class=comments><p>{PROSE}{PROSE}</p></section><form><p>{PROSE}</form></main>", PROSE.strip()),
        (f"<div><p>{PROSE}</p><p>{PROSE}</p></div><div class=menu><p><a>{PROSE}</a></div>", f"{PROSE.strip()}\n\n{PROSE.strip()}"),
        (f"<div class=ad>buy<article><p>{PROSE}</article>", PROSE.strip()), (f"<div class=ad><div>x</div>y</div><p>{PROSE}", PROSE.strip()),
        ("<article><p>tiny</article>", "tiny"), ("a < b <em>c</em> <", "a < b c <"), ("<p>x<!-- <p>no</p> -->y", "xy"), ("<p>cut <foo bar", "cut"),
    ],
)
def test_main_text(html, text):
    assert pages.main_text(html) == text


P = PROSE.strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # Names and structures around the text don't cut it.
        (f"<body><form><div class=content><h1>T</h1><p>{P}</p><p>{P}</p></div><footer>c</footer></form></body>", f"T\n\n{P}\n\n{P}"),
        (f'<div class="with-sidebar"><article><p>{P}</p></article></div>', P),
        (f'<div class="comment-free"><p>{P}</p><p>{P}</p></div>', f"{P}\n\n{P}"),
        (f'<div class="related-story"><p>{P}</p></div>', P),
        (f"<div class=ad>buy now<p>{P}</p><p>{P}</p>", f"{P}\n\n{P}"),
        (f"<h1>Title</h1><div class=ad>buy now<p>{P}</p><p>{P}</p>", f"Title\n\n{P}\n\n{P}"),
        (f'<article><p>{P}</p><p class="social-theory">Short, but kept.</p><p id="notice-period">Kept as well.</p></article>', f"{P}\n\nShort, but kept.\n\nKept as well."),
        (f"<header><a href=/>Site</a></header><article><header><h1>Headline</h1><p>By A. Writer</p></header><p>{P}</p></article>", f"Headline\n\nBy A. Writer\n\n{P}"),
        (f"<article><p>{P}</p><h2>References</h2><ul><li><a href=1>Smith 2001</a><li><a href=2>Jones, a longer title</a></ul></article>", f"{P}\n\nReferences\n\nSmith 2001\n\nJones, a longer title"),
        (f"<main><article><h2>A</h2><p>{P}</p></article><article><h2>B</h2><p>{P}</p></article><article><p>teaser, short, but of some length here</p></article></main>", f"A\n\n{P}\n\nB\n\n{P}"),
        # Boilerplate goes, with and without an article to go by.
        (f"<div id=page><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class=post><h2>T</h2><p>{P}</p><p>{P}</p></div><div class='site-footer'><p>{P}</p></div></div>", f"T\n\n{P}\n\n{P}"),
        (f"<div class=post><p>{P}</p><p>{P}</p><div id=comments><h3>2 comments</h3><p>{P}</p><p>{P}</p><p>{P}</p></div></div>", f"{P}\n\n{P}"),
        (f"<article><p>tiny</p></article><section class='post-comments'><p>{P}</p><p>{P}</p></section>", "tiny"),
        (f"<p>Short body text.</p><div class='cookie-notice'>We use cookies to, well, keep you here, and more.</div>", "Short body text."),
        (f"<div class=wrap><div class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class=text><ul><li><a href=1>Home</a><li><a href=2>Here</a></ul><p>{P}</p><p>{P}</p></div></div>", f"{P}\n\n{P}"),
        (f"<div><form action=/s>Search <input><p>Find, if you can, what you look for here</p></form><p>{P}</p><p>{P}</p></div>", f"{P}\n\n{P}"),
        (f"<nav><p>{P}</p></nav><aside><p>{P}</p></aside><div><p>{P}</p><p>{P}</p></div><dialog><p>{P}</p></dialog>", f"{P}\n\n{P}"),
        (f"<div style='display:none'><p>{P}</p></div><div><p>{P}</p></div>", P), (f"<div id=app style='visibility:hidden'><div><h1>T</h1><p>{P}</p></div></div>", f"T\n\n{P}"),
        (f"<nav><a href=/>Home</a><div><h1>T</h1><p>{P}</p><p>{P}</p>", f"T\n\n{P}\n\n{P}"),
        (f"<table><tr><td><a href=1>x</a></td><td><p>{P}</p><p>{P}</p></td></tr></table>", f"{P}\n\n{P}"),
        ("<section class=comments><p>All there is, a reader's word on it.</p></section>", ""),
        (f"<nav><p>{P}</p></nav><article></article><footer>Copyright, and other notes, of some length.</footer>", ""), ("<footer>Copyright, and other notes, of some length.</footer>", ""),
        (f"<div class=overlay><main><h1>T</h1><p>{P}</p></main></div>", f"T\n\n{P}"),
        (f"<p>{P}<span class=ad>buy</span> <button>Go</button>more</p><p>{P}</p>", f"{P} more\n\n{P}"), (f"<p>{P}</p><p><span class=ad>never closed, but text</p>", f"{P}\n\nnever closed, but text"),
    ],
)
def test_scoring_decides(html, text):
    assert pages.main_text(html) == text


def test_prose_in_nested_suspects_of_any_depth_and_marks_of_any_length():
    for depth in (1, 50, 51, 500):
        for one in ("<div class=ad>", "<form>"):
            assert pages.main_text(one * depth + "<p>" + PROSE) == pages.main_text("<p>" + PROSE)
    for length in (10, 1_900, 2_100, 50_000):
        box = f'<div class="newsletter box" data-x="{"y" * length}"><p>{PROSE}</p></div>'
        assert pages.main_text(f"<article><p>{PROSE}</p>{box}<p>End of it, at last.</p></article>") == f"{pages.main_text('<p>' + PROSE)}\n\nEnd of it, at last."


def test_nested_articles_take_no_quadratic_time():
    import time

    start = time.time()
    assert "word" in pages.main_text("<main>" + "<article><p>word and word, and word.</p>" * 4_000 + "</main>")
    assert time.time() - start < 20


def test_hostile_pages_end_soon():
    import time

    start = time.time()
    for page in ("<a " + "x" * 200_000 + '"', "<div>" * 20_000 + "deep", "<" * 100_000, "<p>" * 50_000 + "x", "&amp" * 50_000, "<form>" * 5_000 + PROSE, "<span class=ad>" * 20_000, "<div class=ad><p>" * 3_000 + PROSE, "<div " + "a=" * 200_000 + ">x", "<div " + "x" * 300_000 + ">x", "<div " + "a='" * 100_000 + ">x"):
        pages.main_text(page)
    assert time.time() - start < 30


def test_extract_keeps_columns_and_rows(rows):
    df = rows("page_id long, html string, main_text string, url string", (1, "<p>a", "old", "u"), (1, "<p>a", "old", "u"), (None, None, None, None))
    got = pages.extract(df).orderBy("page_id").collect()
    assert [(r.page_id, r.main_text, r.url) for r in got] == [(None, "", None), (1, "a", "u"), (1, "a", "u")]
    assert pages.extract(df.where(F.lit(False))).count() == 0
