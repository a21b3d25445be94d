"""Sorted runs against a dictionary."""

import random

import pytest

from quern.operators import runs
from quern.operators.runs import SortedRuns

SCHEMA = "file string, contract string, n long"


def test_batches_and_compactions_equal_a_dictionary(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "FILE_ROWS", 7)
    rng, want = random.Random(4), {}
    table = SortedRuns(spark, f"{tmp_path}/t", "file", 3)
    assert table.read().count() == 0 and not table.compact()
    for k in range(8):
        put = {f"f{rng.randrange(40):02d}": (f"c{k}", k) for _ in range(12)}
        gone = {f"f{rng.randrange(40):02d}" for _ in range(6)}
        table.write(rows(SCHEMA, *[(f, *v) for f, v in put.items()]), rows("file string, x int", *[(f, 1) for f in gone]))
        want = {f: v for f, v in want.items() if f not in gone} | put
    assert {r.file: (r.contract, r.n) for r in table.read().collect()} == want
    assert {r.file for r in table.read("f10", "f19").collect()} == {f for f in want if "f10" <= f <= "f19"}
    levels = [r["level"] for r in table._state()["runs"]]
    assert max(levels) >= 1 and max(levels.count(n) for n in set(levels)) < 3
    before = table.read()
    whole = before.count()
    files = table.read("f10", "f11").inputFiles()
    assert 0 < len(files) < len(before.inputFiles())
    table.write(removed=rows("file string", *[(f,) for f in want]))
    assert table.read().count() == 0 and before.count() == whole  # who reads goes on with what it has
    table.write(rows("file string, m double, n long", ("f01", 0.5, 1)))
    assert [tuple(r) for r in table.read().collect()] == [("f01", None, 1, 0.5)]
    assert table.vacuum() > 0 and table.read().count() == 1
    for bad in ([("a", "x", 1), ("a", "y", 2)], [(None, "x", 1)]):
        with pytest.raises(ValueError):
            table.write(rows(SCHEMA, *bad))
    table.write(rows(SCHEMA))
    assert table.read().count() == 1


def test_writers_and_compactions_that_race(spark, rows, tmp_path):
    one, other = (SortedRuns(spark, f"{tmp_path}/t", "file", 2) for _ in range(2))
    one.write(rows(SCHEMA, ("a", "1", 1)))
    written = one._written

    def slow(batch, n):
        made = written(batch, n)
        one._written = written
        other.fanout = 99
        other.write(rows(SCHEMA, ("a", "2", 2), ("b", "2", 2)))
        return made

    one._written = slow
    one.write(rows(SCHEMA, ("a", "3", 3)))  # committed after the other's
    assert {(r.file, r.n) for r in other.read().collect()} == {("a", 3), ("b", 2)}
