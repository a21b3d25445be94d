"""The git source against git log."""

import subprocess

from pyspark.sql import functions as F

from quern.sources import readers as R
from quern.sources.git import register


def test_all_commits_equal_git_log(spark, tmp_path):
    def git(*a):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True).stdout

    git("init", "-q", "-b", "main")
    for k in range(25):
        (tmp_path / f"f{k % 4}.py").write_text("x\n" * (k + 1))
        (tmp_path / "b.bin").write_bytes(bytes([0, k]))
        if k == 10:
            git("mv", "f0.py", "moved.py")
        git("add", "."), git("commit", "-qm", f"{'fix: ' if k % 5 == 0 else ''}step\x1f {k}")
    git("checkout", "-qb", "side", "HEAD~3")
    (tmp_path / "side.txt").write_text("s\n")
    git("add", "."), git("commit", "-qm", "side"), git("checkout", "-q", "main"), git("merge", "-q", "--no-ff", "-m", "merge", "side")
    want, name = set(), None
    for line in git("log", "--numstat", "--format=%x01%H").splitlines():
        if line.startswith("\x01"):
            name = line[1:]
        elif line and not line.startswith("-"):
            a, d, f = line.split("\t")
            want.add((name, f, int(a), int(d)))
    register(spark)
    rows = spark.read.format("git_log").option("path", str(tmp_path)).option("commits", 4).load()
    got = [(r.commit, r.file, r.insertions, r.deletions) for r in rows.collect()]
    assert set(got) == want and len(got) == len(want) and rows.rdd.getNumPartitions() == 7
    assert {(r.commit, r.file) for r in rows.where("file = 'f1.py'").collect()} == {(c, f) for c, f, _, _ in want if f == "f1.py"}
    assert {(r.commit, r.file) for r in rows.where(F.col("commit") == name).collect()} == {(c, f) for c, f, _, _ in want if c == name}
    history = R.git_history(spark, str(tmp_path))
    assert history.where("is_fix").select("commit").distinct().count() == 5 and {r.subject for r in history.where("subject like '%side%'").collect()} == {"side"}
    assert R.git_history(spark, str(tmp_path), 2).select("commit").distinct().count() <= 2
