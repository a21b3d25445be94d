"""The pipeline's near-duplicates against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import pytest
from quern.llm import jaccard
from tests.llm.test_dedup import grouped, plain_fingerprint


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(seed, n=30):
    rng = random.Random(seed)
    out = ["", None, "one two", "One  two", "one two three"]
    for _ in range(n):
        base = ["w%d" % rng.randrange(5000) for _ in range(rng.randrange(40, 250))]
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = "x%d" % rng.randrange(5000)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_stage_drops_edited_copies(spark, rows, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = edited(block)
    ids = list(range(1, len(texts) + 1))
    sets, fps = [plain_shingles(t) for t in texts], [plain_fingerprint(t) for t in texts]
    linked = lambda a, b: similarity(sets[a], sets[b]) >= 0.8 or (fps[a] ^ fps[b]).bit_count() <= 2
    want = grouped(len(ids), linked, ids)
    only = grouped(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2, ids)
    assert len(set(want)) < len(set(only))
    docs = rows("doc_id long, text string, lang string, source string, n_chars long", *[(i, t, "en", "s", 1) for i, t in zip(ids, texts)])
    one = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, None)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(want))


def test_near_copies_without_an_id(spark, rows):
    base = ["w%d" % k for k in range(100)]
    near = [*base[:50], "other", *base[51:]]
    docs = rows("doc_id long, text string", (5, " ".join(base)), (None, " ".join(near)), (None, "lone text of its own here"))
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, None).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 5] and any(r.text.startswith("lone") for r in got)


def test_texts_of_one_id_are_rows_of_their_own(spark, rows):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = rows("doc_id long, text string, lang string", (1, a, "en"), (1, b, "en"), (1, a, "de"), (1, a, "en"), (2, b, "en"), (None, a, None), (None, "", None), (None, None, None))
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, None).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, a), (1, b), (0, "")])
