"""Changes of a tree reach the index once each, also after a restart."""

from quern.sources.watch import TreeChanges, TreeReader
from quern.streaming import streams as S


def test_changes_reach_the_index_once(spark, tmp_path):
    tree, seen = tmp_path / "tree", []
    (tree / "src").mkdir(parents=True)
    (tree / ".git").mkdir()
    (tree / ".git" / "x").write_text("no")
    for name, text in (("a.py", "1"), ("src/b.py", "2"), ("src/c.py", "3")):
        (tree / name).write_text(text)
    spark.dataSource.register(TreeChanges)

    def run():
        files = spark.readStream.format("tree_changes").option("path", str(tree)).option("state", f"{tmp_path}/state").option("quiet", "0").option("files", "2").load()
        index = S.delta_stream(files, f"{tmp_path}/index")

        def both(batch, number):
            seen.append(sorted(r.path for r in batch.collect()))
            index(batch, number)

        query = files.writeStream.foreachBatch(both).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return {r.path: r.text for r in S.keyed_table(spark, f"{tmp_path}/index").collect()}

    assert run() == {"a.py": "1", "src/b.py": "2", "src/c.py": "3"}
    (tree / "a.py").write_text("1 and more")
    (tree / "src" / "b.py").unlink()
    (tree / "d.py").write_bytes(b"\xff4")
    assert run() == {"a.py": "1 and more", "src/c.py": "3", "d.py": "�4"}
    assert run() == {"a.py": "1 and more", "src/c.py": "3", "d.py": "�4"}
    assert [s for s in seen if s] == [["a.py", "src/b.py", "src/c.py"], ["a.py", "d.py", "src/b.py"]]


def test_a_file_that_is_being_written_waits(tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a").write_text("x")
    slow = TreeReader({"path": f"{tmp_path}/tree", "state": f"{tmp_path}/state", "quiet": "3600"})
    assert slow.latestOffset() == {"listing": 0} == slow.initialOffset()
    fast = TreeReader({"path": f"{tmp_path}/tree", "state": f"{tmp_path}/state", "quiet": "0"})
    assert fast.latestOffset() == fast.latestOffset() == {"listing": 1}
    (tmp_path / "tree" / "a").write_text("xyz")
    assert slow.latestOffset() == {"listing": 1}  # as it was before
    (tmp_path / "tree" / "a").unlink()
    assert slow.latestOffset() == {"listing": 2}
    assert [tuple(r)[:3] for p in slow.partitions({"listing": 1}, {"listing": 2}) for r in slow.read(p)] == [("a", 2, None)]
