"""URL rules and vector codes against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from quern.llm import codes, urls


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?", 1)[0].split("#", 1)[0]
    best, verdict = None, "allow"
    for rule, v in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            mine, top = (len(rule), len(h)), best and (len(best), len(best.partition("/")[0]))
            if best is None or mine > top or (rule == best and v == "block"):
                best, verdict = rule, v
    return host, path, best, verdict


URLS = [
    None, "", "net/", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net/", "http://anet/", "x://a.example.net/en/1", "x://example.net/en",
    "x://example.net/en/?a=/", "x://example.net/fr/", "x://Example.COM/de/#a", "x://example.com/de", "x://y/x://net/", "a\nb://net/c\nd#e", "x://org/fr/", "x://É.org/fr/É",
    "x://u:p@example.org:80/fr/", "x://.net/", "x://net./", "x://..net//", "x://net?/en/", "x://net#/", "x://" + "a." * 5000 + "net/" + "b" * 100_000,
]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_rules_of_urls(rows):
    table = rows("page_id long, url string, rule string, host int", *[(k, u, "z", 1) for k, u in enumerate([*URLS, "x://net/"])], (None, "x://net/", "z", 1))
    got = urls.judge(table, rows("rule string, verdict string, note string", *[(*r, "n") for r in RULES])).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {(k, *plain_verdict(u, RULES)) for k, u in [*enumerate([*URLS, "x://net/"]), (None, "x://net/")]}
    assert len(got) == len(URLS) + 2
    assert urls.judge(rows("page_id long, url string"), rows("rule string, verdict string", *RULES)).count() == 0
    assert [r.verdict for r in urls.judge(rows("page_id long, url string", (1, "x://net/")), rows("rule string, verdict string")).collect()] == ["allow"]


@pytest.mark.parametrize("most_bits", [1 << 20, 4096])
def test_many_rules_in_one_and_in_several_parts(rows, most_bits):
    rng = random.Random(2)
    rules = list({("%s/%s" % (".".join(rng.choice("abcdef") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 4))), "p/" * rng.randrange(3)), rng.choice(["block", "allow"])) for _ in range(1500)})
    rules += [("a/", "allow"), ("a/", "block"), ("b", "allow"), (None, "block")]
    table = ["%s://%s/%s" % (rng.choice(["http", "x"]), ".".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 5))), "p/" * rng.randrange(4)) for _ in range(1500)]
    got = urls.judge(rows("page_id long, url string", *enumerate(table)), rows("rule string, verdict string", *rules), most_bits=most_bits).collect()
    whole = [r for r in rules if r[0] is not None]
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {(k, *plain_verdict(u, whole)) for k, u in enumerate(table)}


def test_cascade_is_exact_over_its_universe(rows, monkeypatch):
    monkeypatch.setattr(urls, "FIRST_BITS", 2)
    monkeypatch.setattr(urls, "FIRST_HASHES", 1)
    keys = [b"%d" % k for k in range(20_000)]
    listed = rows("key binary", *[(k,) for k in keys[::7]], (keys[0],), (None,))
    for most in (1 << 20, 2048):
        found = urls.cascade(listed, rows("key binary", *[(k,) for k in keys], (keys[5],), (None,)), most)
        assert len(found.parts) == (1 if most > 2048 else 3) and all(len(p) > 3 for p in found.parts)
        assert (found.holds(keys) == [k % 7 == 0 for k in range(20_000)]).all()
    assert not urls.cascade(rows("key binary"), listed).holds(keys).any()


def plain_codes(table, rounds=6):
    kept = sorted(((i, label, [math.floor(4096 * x) for x in v]) for i, label, v in table if v is not None and None not in v and all(map(math.isfinite, v))), key=lambda r: r[0])
    width = len(kept[0][2]) // 8
    parts = [[v[p * width : (p + 1) * width] for _, _, v in kept] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            mine = {}
            for x in parts[p]:
                mine.setdefault(nearest(x, books[p])[1], []).append(x)
            for e, xs in mine.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    out, by_label = {}, {}
    for k, (i, label, _) in enumerate(kept):
        best = [nearest(parts[p][k], books[p]) for p in range(8)]
        out[i] = ("".join("%02x" % e for _, e in best), sum(d for d, _ in best))
        by_label[label] = by_label.get(label, 0) + out[i][1]
    return {(i, *out[i], by_label[label], sha) for i, label, _ in kept}


def vectors(n=300, width=16, scale=0.3, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (20, width))
    table = [(int(k) * 3 - 50, int(k) % 5 if k % 7 else None, (centres[k % 20] + rng.normal(0, scale / 5, width)).tolist()) for k in rng.permutation(n)]
    return table + [(-1000, 1, None), (-1001, 1, [None] * width), (-1002, 1, [math.nan] * width), (-1003, None, [math.inf] * width), (5000, 2, [0.0] * width), (5001, 2, [0.0] * width)]


@pytest.mark.parametrize("n, width, scale", [(300, 16, 0.3), (40, 64, 1e-3), (9, 8, 2.0), (60, 8, 1e9), (60, 16, 1e5)])
def test_codes_equal_brute_force(rows, n, width, scale):
    table = vectors(n, width, scale)
    df = rows("vec_id long, label int, embedding array<double>, code int", *[(*r, 1) for r in table]).repartition(3)
    want = plain_codes(table)
    if scale >= 1e9:  # errors beyond 64 bits are null
        got = {(r.vec_id, r.code, r.codebooks_sha256) for r in codes.encode(df).collect()}
        assert got == {(i, c, sha) for i, c, _, _, sha in want}
    else:
        assert {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.encode(df).collect()} == want


def test_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(0)
    entries, x = rng.integers(-1000, 1000, (16, 8)), rng.integers(-1500, 1500, (500, 8))
    book = codes.Codebook(entries)
    exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    lower, upper = book.bounds(x)
    assert (lower <= exact).all() and (exact <= upper).all()
    code, error, compared = book.nearest(x)
    assert (code == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all() and compared < exact.size / 2
    same = codes.Codebook(np.zeros((16, 8), np.int64))
    assert (same.nearest(x)[0] == 0).all()


def test_codes_of_several_widths_and_none(rows):
    schema = "vec_id long, label string, embedding array<float>"
    assert codes.encode(rows(schema)).count() == 0
    table = [(1, "a", [0.5] * 8), (1, "a", [0.5] * 8), (2, None, [0.25] * 3), (3, None, []), (None, "b", [1.0] * 8)]
    got = sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in codes.encode(rows(schema, *table)).collect())
    assert got == [(0, "02" * 8, 0, 0), (1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0), (3, "00" * 8, 0, 0)]
