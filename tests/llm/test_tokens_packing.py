"""Encoder, packing and token files against the tokenizers library and counting."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import binfile, packing
from quern.llm.queries import vocabulary
from quern.llm.tokens import Encoder

TEXTS = [None, "", "one two", "one two", " \n\t  x", "a  b   c\n\n\nd ", "naïve café 12½ it's!!", "中文 字 😀 ok", "<|endoftext|>", "word " * 3000, "\xa0x　y", "z" * 20_000, "end\n\n", "é\n\na"]


@pytest.fixture(scope="module")
def library():
    return Encoder(vocabulary()).tokenizer


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_library(library):
    encoder, rng = Encoder(vocabulary(), most_words=50), random.Random(1)
    pools = (" \nab,", "  \n\n\tab's1.", "é ñ\nA!!*", "\xa0　 ab\n中文😀", "ab 12²½ÀZ're'll \n|<>", "\x1c\x85  a\r")
    texts = ["".join(rng.choice(p) for _ in range(rng.randrange(14))) for _ in range(3000) for p in [rng.choice(pools)]]
    for t in texts + [t for t in TEXTS if t]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids_of(library, t)[:-1], repr(t)


def test_pack_lengths_loses_nothing_and_pads_nothing():
    rng = random.Random(2)
    for lengths in ([], [1], [1024], [1023, 1], [5000, 3, 3, 3], [rng.randrange(1, 3000) for _ in range(700)], [1000] * 90, [1] * 2100):
        pieces, count = packing.pack_lengths(lengths)
        covered = {k: [] for k in range(len(lengths))}
        sequences = {}
        for k, start, n, seq, offset in pieces:
            assert n > 0
            covered[k].append((start, n))
            sequences.setdefault(seq, []).append((offset, n))
        for k, parts in covered.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at == lengths[k]
        assert sorted(sequences) == list(range(count))
        sizes = []
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            sizes.append(at)
        assert all(s & (s - 1) == 0 and s <= 1024 for s in sizes) and sum(sizes) == sum(lengths)
        assert sum(s < 1024 for s in sizes) <= 10


def test_combinations_fill_the_window_and_least_squares_match():
    histogram = np.zeros(1024, int)
    histogram[[300, 724, 100, 200]] = [10, 7, 3, 3]
    parts = packing.combinations(histogram, 1024)
    assert (parts.sum(axis=1) == 1024).all() and [0, 300, 724] in parts.tolist() and [100, 200, 724] in parts.tolist()
    x = packing.least_squares(parts, histogram)
    assert (x >= 0).all() and np.rint(x).sum() >= 7


@pytest.fixture
def docs(rows):
    schema = "doc_id long, text string, part string, ids string, start int"
    return rows(schema, *[(k, t, "clash", "clash", k) for k, t in enumerate(TEXTS)], (None, "no id", None, None, None), (2, "one two", None, None, None))


def test_packed_pieces(docs, library):
    got = packing.number(packing.pack(docs, vocabulary())).collect()
    per = {}
    for r in got:
        per.setdefault((r.part, r.doc_key), []).append(r)
    assert len(per) == len(TEXTS) + 2
    for parts in per.values():
        parts.sort(key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist()
        text = "no id" if parts[0].doc_id is None else TEXTS[parts[0].doc_id]
        assert ids == ids_of(library, text) and parts[0].doc_tokens == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(sum(n for _, n in s) <= 1024 for s in sequences.values())


def test_token_files(docs, library):
    manifest = binfile.write_tokens(docs.where("doc_id is not null"), vocabulary())
    got = binfile.read_tokens(manifest).orderBy("start").collect()
    ordered = sorted([*enumerate(TEXTS), (2, "one two")], key=lambda x: x[0])
    assert [r.doc_id for r in got] == [k for k, _ in ordered]
    at = 0
    for r, (_, text) in zip(got, ordered):
        ids = ids_of(library, text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    shard = manifest.first()
    with binfile.mapped(f"{shard.stem}.tokens", shard.dtype) as tokens:
        assert isinstance(tokens, np.memmap) and len(tokens) == shard.n_tokens and tokens.dtype == np.uint16


def test_files_are_read_in_slices_and_by_ranges(docs, monkeypatch):
    manifest = binfile.write_tokens(docs, vocabulary())
    want = sorted(map(tuple, binfile.read_tokens(manifest).collect()), key=lambda r: r[1])
    rows = [r.asDict() for r in manifest.collect()]
    monkeypatch.setattr(binfile, "SLICE_DOCS", 3)
    monkeypatch.setattr(binfile, "SLICE_IDS", 50)

    def read():
        return sorted((tuple(r.values()) for row in rows for batch in binfile._documents(row) for r in batch.to_pylist()), key=lambda r: r[1])

    assert read() == want
    monkeypatch.setattr(binfile, "_local", lambda url: None)
    assert read() == want


def test_rows_of_one_id_are_dealt_to_several_shards(spark, rows, library):
    docs = rows("doc_id long, text string", *[(7, f"text {k}") for k in range(400)], *[(None, f"t {k}") for k in range(400)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = binfile.write_tokens(docs, vocabulary())
        assert manifest.count() > 2 and binfile.read_tokens(manifest).rdd.getNumPartitions() == manifest.count()
        got = binfile.read_tokens(manifest).orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.doc_id for r in got] == [None] * 400 + [7] * 400
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))


def test_null_ids_and_empty_tables(docs):
    got = binfile.read_tokens(binfile.write_tokens(docs.where("doc_id is null or doc_id = 2"), vocabulary())).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2]
    none = docs.where(F.lit(False))
    assert binfile.read_tokens(binfile.write_tokens(none, vocabulary())).count() == 0
    assert packing.number(packing.pack(none, vocabulary())).count() == 0
