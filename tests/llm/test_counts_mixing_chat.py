"""Rollups, mixing and chat formatting on small inputs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from quern.llm import chat, counts, mixing, queries
from tests.oracle import connect

COUNTS = "source string, lang string, tokenizer string, n_tokens long, new_tokens long"


def totals(ledger):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}


def test_signed_changes_and_repeated_commits(spark, rows):
    ledger = counts.Ledger(spark)
    assert totals(ledger) == {}
    first = rows(COUNTS, ("a", "en", "t", 5, 5), ("a", "en", "t", 7, 9), (None, "en", "t", 3, 3), ("b", None, "t", None, None))
    assert ledger.commit("one", counts.inserted(first))
    assert totals(ledger) == {("a", "en"): (2, 12), (None, "en"): (1, 3), ("b", None): (1, 0)}
    assert not ledger.commit("one", counts.inserted(first)) and counts.Ledger(spark, ledger.folder).committed("one")
    assert ledger.commit("two/odd id", counts.revised(first.where("n_tokens = 7")), counts.deleted(first.where("source is null")))
    assert totals(ledger) == {("a", "en"): (2, 14), ("b", None): (1, 0)}
    assert ledger.commit("empty", counts.inserted(first.where(F.lit(False))))
    assert totals(ledger) == {("a", "en"): (2, 14), ("b", None): (1, 0)}


def test_two_writers_of_one_batch(spark, rows, monkeypatch):
    """The second writer begins and ends between the first one's check and its marker."""
    folder = counts.Ledger(spark).folder
    first, second = counts.Ledger(spark, folder), counts.Ledger(spark, folder)
    change = counts.inserted(rows(COUNTS, ("a", "en", "t", 5, 5)))
    publish, done = first._publish, []

    def late(text, *parts):
        done.append(second.commit("one", change))
        return publish(text, *parts)

    monkeypatch.setattr(first, "_publish", late)
    assert not first.commit("one", change) and done == [True]
    assert totals(first) == totals(second) == {("a", "en"): (1, 5)}
    assert not second.commit("one", change)


def test_a_dead_writer_leaves_nothing(spark, rows, monkeypatch):
    ledger = counts.Ledger(spark)
    change = counts.inserted(rows(COUNTS, ("a", "en", "t", 5, 5)))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(ledger, "_publish", die)
        ledger.commit("one", change)
    assert totals(ledger) == {} and not ledger.committed("one")
    assert ledger.commit("one", change) and totals(ledger) == {("a", "en"): (1, 5)}
    assert ledger.vacuum() == 1 and totals(ledger) == {("a", "en"): (1, 5)}


def test_compaction_keeps_totals(spark, rows):
    ledger = counts.Ledger(spark)
    change = rows(COUNTS, ("a", "en", "t", 5, 6), (None, "en", "t", 2, 2))
    ledger.commit("one", counts.inserted(change))
    ledger.commit("two", counts.revised(change))
    want = {("a", "en"): (1, 6), (None, "en"): (1, 2)}
    assert ledger.compact() and totals(ledger) == want
    assert not ledger.commit("one", counts.inserted(change)) and totals(ledger) == want
    ledger.commit("three", counts.inserted(change))
    assert totals(ledger) == {("a", "en"): (2, 11), (None, "en"): (2, 4)}
    other = counts.Ledger(spark, ledger.folder)
    assert ledger._publish("{}", "snapshots", "000000000009") and not other._publish("{}", "snapshots", "000000000009")


def test_token_counts_query_against_libraries(spark, sf_dir):
    """op1's rows from whole texts, counted one by one."""
    import base64

    import tiktoken

    def encoding(name):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary(name), "rb"))}
        return tiktoken.Encoding("own", pat_str=counts.PATTERN, mergeable_ranks=ranks, special_tokens={})

    library = Tokenizer.from_file(queries.vocabulary())
    library.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    first = {}
    for r in docs:
        first[r.text or ""] = min(r.doc_id, first.get(r.text or "", r.doc_id))
    want, multi = {}, encoding("byte_bpe_multi_50k.tiktoken")
    for r in docs:
        if first[r.text or ""] == r.doc_id:
            a, b = len(library.encode(r.text or "", add_special_tokens=False).ids), len(multi.encode_ordinary(r.text or "")) + 1
            for version, n in (("byte-bpe-50k", a), ("byte-bpe-multi-50k", b)):
                t = want.setdefault((r.source, r.lang, version), [0, 0])
                t[0], t[1] = t[0] + 1, t[1] + n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in queries.op1_token_counts(spark, sf_dir).collect()}
    assert got == want


def test_token_counts_of_odd_rows(spark, rows):
    docs = rows("doc_id long, text string, source string, lang string, counts int", (1, None, None, None, 5), (1, "", "s", "en", 5), (None, "word " * 50_000, "s", "en", 5))
    names = [queries.vocabulary(f) for f in queries.TOKENIZERS.values()]
    got = counts.token_counts(docs, names).collect()
    assert sorted(len(r.counts) and r.counts[0] for r in got) == [0, 0, 50_001]
    assert counts.token_counts(docs.where(F.lit(False)), names).count() == 0


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while above := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]]:
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}


def test_targets_share_the_excess(rows):
    rng = np.random.default_rng(4)
    many = {f"s{k:03d}": int(rng.pareto(0.5) * 10) + (k % 5 == 0) for k in range(60)}
    for sizes in ({"a": 100, "b": 100, None: 100}, {"b": 10, "a": 1000, "c": 0}, {}, {"x": 0}, {"\0": 5, None: 7, "": 9, "é": 3, "z": 40}, many):
        table = rows("source string, size long", *[(s, n - n // 3) for s, n in sizes.items()], *[(s, n // 3) for s, n in sizes.items()])
        got = {r.source: (r.source_size, r.target) for r in mixing.targets(table).collect()}
        assert {s: t for s, (_, t) in got.items()} == pytest.approx(plain_targets(sizes)) and {s: n for s, (n, _) in got.items()} == sizes


def test_mixing_query_sizes_and_targets(spark, sf_dir):
    """size, source_size and target of op5 against SQL, and what is taken against its bounds."""
    got = queries.op5_source_mixing(spark, sf_dir).collect()
    con = connect(sf_dir)
    sizes = con.execute(r"SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents").fetchall()
    assert sorted((r.doc_id, r.source or "", r["size"]) for r in got) == sorted((i, s or "", n) for i, s, n in sizes)
    per = {}
    for _, s, n in sizes:
        per[s] = per.get(s, 0) + n
    want, taken = plain_targets(per), dict.fromkeys(per, 0)
    for r in got:
        assert r.source_size == per[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and r.copies in (0, 1, 2)
        taken[r.source] += r.taken
    longest = max(n for _, _, n in sizes)
    assert all(abs(taken[s] - want[s]) <= longest for s in per)


def test_many_equal_rows_are_numbered_by_parts(rows, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 4)
    docs = rows("doc_id long, text string, source string", *[(None, "a b", "s")] * 23, *[(1, "c", None)] * 5)
    got = mixing.mix(docs).collect()
    assert len(got) == 28 and sum(r.source is None for r in got) == 5
    for source, words in (("s", 2), (None, 1)):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.copies * words for r in mine) - mine[0].target) <= words


def test_pivot_keeps_the_sum_and_the_mean():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 60).astype(float)
    fraction = rng.random(60)
    taken = np.zeros(60)
    for _ in range(3000):
        out, open_ = mixing.pivot(fraction.copy(), size, rng.random(60))
        assert out @ size == pytest.approx(fraction @ size)
        left = [k for k in range(60) if 0 < out[k] < 1]
        assert left == ([open_] if open_ >= 0 else [])
        taken += out
    assert np.abs(taken / 3000 - fraction).max() < 0.05


def test_mix_meets_targets_and_repeats(rows):
    rng = np.random.default_rng(2)
    data = [(k, "w " * int(rng.integers(1, 60)), ["a", "b", None, "c"][k % 4] if k % 3 else "a", "x") for k in range(6000)]
    docs = rows("doc_id long, text string, source string, copies string", *data)
    got = mixing.mix(docs).collect()
    assert len(got) == 6000
    per = {}
    for r in got:
        assert 0 <= r.copies <= 2
        t = per.setdefault(r.source, [0, r.target, r.source_size, 0])
        t[0] += r.copies * r["size"]
        t[3] += r["size"]
    for taken, target, source_size, total in per.values():
        assert abs(taken - target) <= 60 and total == source_size
    again = {(r.id): r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.id: r.copies for r in got}


def test_mix_edge_rows(rows):
    docs = rows("doc_id long, text string, source string", (1, None, None), (1, None, None), (None, "a b", "s"), (2, "a b", "s"), (2, "a b", "s"), (3, "", "empty"))
    got = sorted((r.id or 0, r["size"], r.source or "") for r in mixing.mix(docs).collect())
    assert got == [(0, 2, "s"), (1, 0, ""), (1, 0, ""), (2, 2, "s"), (2, 2, "s"), (3, 0, "empty")]
    assert mixing.mix(docs.where(F.lit(False))).count() == 0


def test_escapes_are_reversible():
    for t in ("", "<|im_end|>", "<\\|x", "<\\\\|", "<|<\\|", "< |", "<||>", "a<\\"):
        e = chat.escape(t)
        assert chat.unescape(e) == t and "<|" not in e


def test_parts_become_placeholders():
    parts = '[{"type": "text", "text": "see <|"}, {"type": "image", "url": "u", "width": 56, "height": 29}, "and", {"type": "audio", "path": "p", "seconds": 2}, {"type": "document", "id": 7, "pages": 3}, {"type": "new", "x": 1}, null]'
    v = chat.flatten("ignored", parts)
    text = "".join(v.out)
    assert text.startswith("see <\\|<|image_1|>and<|audio_2|><|document_3|>")
    assert [(a["kind"], a["reference"], a["tokens"]) for a in v.attachments] == [("image", "u", 4), ("audio", "p", 50), ("document", "7", 768)]
    assert all(text[a["position"] :].startswith(f"<|{a['kind']}_{k}|>") for k, a in enumerate(v.attachments, 1))
    assert "".join(chat.flatten("plain", "not json").out) == "not json" and "".join(chat.flatten(None).out) == ""


def test_parts_of_any_size(rows):
    parts = ['[{"type": "image", "width": 1000000000, "height": 1000000000}, {"type": "document", "pages": 1e300}]', '[{"type": "audio", "seconds": -1}, {"type": "image", "width": "x"}]', "[]", "[[1]]"]
    turns = rows("conv_id long, turn long, role string, text string, parts string", *[(k, 0, "user", "t", p) for k, p in enumerate(parts)])
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns, "parts")).collect()}
    assert got[0].expanded_tokens == chat.MOST_TOKENS and [got[k].attachments for k in range(4)] == [2, 2, 0, 0] and got[1].expanded_tokens == 26


def test_conversations_round_trip(spark, rows):
    data = [(1, 0, "system", "be\nkind"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>é"), (1, 2, "assistant", "<|im_end|>é"), (2, 0, None, "x<\\|"), (None, None, "assis\ntant<|", ""), (3, 1, "assistant", "b"), (3, None, "assistant", "a")]
    turns = rows("conv_id long, turn long, role string, text string, formatted string", *[(*d, "clash") for d in data])
    out = chat.format_turns(turns)
    assert all(chat.read_turn(r.formatted)[0] == r.role for r in out.collect())
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    want = {}
    for c, t, role, text in sorted(data, key=lambda d: (d[0] or 0, -1 if d[1] is None else d[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    for c, ts in want.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(ts), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_turns(turns.where(F.lit(False)))).count() == 0
    with pytest.raises(ValueError):
        chat.read_turn("no turn")
