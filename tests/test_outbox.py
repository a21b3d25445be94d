"""Several consumers of one queue: leases, fences, retries, repeated and late deliveries."""

from threading import Thread

import pytest

from quern.streaming.outbox import MOST_FOLDERS, Outbox

SCHEMA = "id long, payload string"


def handler(pdf):
    return ["bad" if p == "x" else None for p in pdf["payload"]]


@pytest.fixture
def queue(spark, tmp_path):
    clock = [1000.0]
    box = Outbox(spark, f"{tmp_path}/q", SCHEMA, 4, 60, 2, lambda: clock[0])
    box.clock = clock
    return box


def state(box):
    return {r.id: (r.status, r.retry_count, r.handled_by) for r in box.events().collect()}


def test_a_dead_consumer_and_its_successor(queue, rows):
    queue.put(rows(SCHEMA, *[(k, "x" if k == 3 else "ok") for k in range(20)], (3, "x"), (None, "ok")), "w", 0)
    queue.put(rows(SCHEMA, (99, "ok")), "w", 0)  # delivered again: adds nothing
    assert set(state(queue)) == set(range(20)) and state(queue)[3] == ("NEW", 0, None)
    dead = queue.claim("a")
    folder = queue.handle(dead, "a", handler)
    assert len(dead) == 4 and queue.claim("b") == [] and queue.consume("b", handler) == 0
    queue.clock[0] += 59
    assert queue.renew(dead) == dead
    queue.clock[0] += 59
    assert queue.claim("b") == []  # renewed
    queue.clock[0] += 2
    ours = queue.claim("b")
    assert [c.fence for c in ours] == [2] * 4 and queue.renew(dead) == []
    assert queue.settle(dead, folder) == []  # too late: nothing of it counts
    assert all(v == ("NEW", 0, None) for v in state(queue).values())
    assert queue.settle(ours, queue.handle(ours, "b", handler)) == ours
    assert queue.settle(dead, folder) == [] and queue.settle(ours, folder) == []
    assert state(queue) == {k: ("PENDING", 1, "b") if k == 3 else ("PROCESSED", 0, "b") for k in range(20)}
    assert queue.consume("a", handler) == 0  # not due
    queue.put(rows(SCHEMA, (3, "ok"), (4, "x"), (20, "ok")), "v", 0)  # known ids change nothing
    queue.consume("a", handler)
    assert state(queue)[3] == ("PENDING", 1, "b") and state(queue)[4] == ("PROCESSED", 0, "b") and state(queue)[20] == ("PROCESSED", 0, "a")
    queue.clock[0] += 3
    assert queue.consume("a", handler) == 1
    assert state(queue)[3] == ("FAILED", 2, "a") and queue.claim("a") == []


def test_consumers_that_race_share_the_parts(queue, rows):
    queue.put(rows(SCHEMA, *[(k, "ok") for k in range(50)]), "w", 0)
    got = {}

    def work(name):
        got[name] = queue.claim(name, 2)

    threads = [Thread(target=work, args=(n,)) for n in "abc"]
    [t.start() for t in threads], [t.join() for t in threads]
    parts = [c.part for claims in got.values() for c in claims]
    assert sorted(parts) == [0, 1, 2, 3]
    for name, claims in got.items():
        if claims:
            assert queue.settle(claims, queue.handle(claims, name, handler)) == claims
    assert {v[:2] for v in state(queue).values()} == {("PROCESSED", 0)} and len(state(queue)) == 50


def test_folders_are_joined_and_swept(queue, rows, tmp_path):
    for k in range(MOST_FOLDERS + 2):
        queue.put(rows(SCHEMA, (1, "ok"), (k + 10, "x" if k == 0 else "ok")), "w", k)
        queue.consume("a", handler)
    parts = queue.versions.newest()[1]["parts"]
    assert max(len(p["settled"]) for p in parts) <= MOST_FOLDERS
    want = state(queue)
    assert len(want) == MOST_FOLDERS + 3 and want[10] == ("PENDING", 1, "a")
    before = len(queue.versions.listed("data"))
    queue.sweep(1000)
    assert len(queue.versions.listed("data")) == before
    queue.sweep(-1)
    assert len(queue.versions.listed("data")) < before and len(queue.versions.numbers()) == 1 and state(queue) == want


def test_an_empty_queue(queue, rows):
    assert queue.events().count() == 0 and queue.claim("a") == [] and queue.consume("a", handler) == 0
    queue.put(rows(SCHEMA), "w", 0)
    assert queue.events().count() == 0 and queue.consume("a", handler) == 0
    queue.put(rows(SCHEMA, (1, "ok")), "w", 1)
    assert queue.consume("a", handler) == 1 and state(queue) == {1: ("PROCESSED", 0, "a")}
