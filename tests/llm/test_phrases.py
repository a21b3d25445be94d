"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quern.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, max_n=4, least=30, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_n + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed=3, texts=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "a\x01", "a\x00", "é", "É", "ﬀ", "\U0001f600", "x\x1cy", "w\xa0w", *["w%d" % k for k in range(60)]]
    weights = [40, 10, 20, 10, 5, 5, 5, 5, 5, 5, 5, 5, *[2] * 60]
    fixed = ["one two three four five", "red red red red red", "the of the of", "new york city", "new york"]
    docs = [(None, None), ("en", None), ("en", ""), ("de", " \t\n.,"), ("und", "new york"), ("x\ny", "a b " * 40)]
    for k in range(texts):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            parts.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choices(words, weights)[0])
            parts.append(rng.choice([" ", " ", " ", " ", "  ", "\t", "\n", ". ", "?", ",", "\x0b", "\r\n"]))
        docs.append((rng.choice(["en", "en", "en", "de", None]), "".join(parts)))
    return docs + docs[-5:]


@pytest.mark.parametrize("share, hot, least, max_n", [(2000, 10_000, 30, 4), (30, 10, 5, 4), (10, 0, 3, 3)])
def test_collocations_equal_brute_force(rows, monkeypatch, share, hot, least, max_n):
    """Also with words that lengthen the shuffle key."""
    docs = corpus()
    monkeypatch.setattr(phrases, "SHARE", share)
    monkeypatch.setattr(phrases, "LEAST_HOT", hot)
    table = rows("lang string, text string, phrase string, n int", *[(a, b, "x", 1) for a, b in docs]).repartition(5)
    got = phrases.collocations(table, max_n, least)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, max_n, least)
    if max_n == 3:
        few = phrases.collocations(table, max_n, least, most=3)
        assert sorted(tuple(r) for r in few.collect()) == plain(docs, max_n, least, most=3)


def test_chunks_and_blocks(monkeypatch):
    """The tasks' own code in small chunks, and the stack in blocks of any size."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    suffixes = Counter(tuple(rng.choice(["a", "b", "c", ""]) for _ in range(4)) for _ in range(300))
    suffixes = Counter({tuple((w if all(s[: k + 1]) else "") for k, w in enumerate(s)): n for s, n in suffixes.items() if s[0]})
    rows = sorted(suffixes.items(), reverse=True)
    want = Counter()
    for s, n in rows:
        for k in range(1, 5):
            if s[k - 1]:
                want[s[:k]] += n
    for block in (1, 2, 7, 1000):
        stack, got = phrases._Stack(4, 1), Counter()
        for a in range(0, len(rows), block):
            part = rows[a : a + block]
            lines = [" ".join([*s[1:], str(n)]) for s, n in part]
            closed = list(stack.push(pa.table([pa.array([s[0] for s, _ in part]), pa.array(lines), pa.array(np.ones(len(part), np.int32))], names=["first", "line", "depth"])))
            for k, words, n in [*closed, *(stack.close() if a + block >= len(rows) else ())]:
                for i, count in enumerate(n):
                    key = tuple(w[i].as_py() for w in words)
                    assert key not in got and len(key) == k
                    got[key] = int(count)
        assert got == want
    texts = pa.record_batch([pa.array(["x"] * 50), pa.array([b"a b. C d"] * 50)], names=["lang", "text"])
    monkeypatch.setattr(phrases, "CHUNK", 20)
    assert len(list(phrases._chunks(iter([texts])))) > 10


def test_very_long_words_and_empty_table(rows):
    assert phrases.collocations(rows("lang string, text string")).count() == 0
    long = "z" * 200_000
    got = phrases.collocations(rows("lang string, text string", *[("en", f"{long} {long} y")] * 3), least=3)
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()] == [(f"{long} {long} y", 3, 6, 3, 9, 666_666)]
