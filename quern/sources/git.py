"""The history of a git repository as a data source: commits are dealt to tasks, which run git themselves.

    git.register(spark)
    spark.read.format("git_log").option("path", "/shared/repository").load()

The repository has to be where all executors see it. The driver lists the commits' names only
(41 bytes each)."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

#: An entry's header: name, author, seconds and subject, behind a mark that starts it.
FORMAT = "%x01%H%x1f%an%x1f%at%x1f%s"


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets it take filters, which the setting allows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitLog)


class Commits(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class GitLog(DataSource):
    """(commit, author, at, subject, file, insertions, deletions): a row per commit and text file,
    as of ``git log --numstat``: merges and binary files have none.

    Options: ``path``; ``revision`` (HEAD); ``commits`` to a task (1,000); ``most``, the newest
    commits only (all). Filters of equality on commit and file are git's own work."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "commit string, author string, at long, subject string, file string, insertions long, deletions long"

    def reader(self, schema) -> DataSourceReader:
        return GitReader({k.lower(): v for k, v in self.options.items()})


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.wanted = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("commit",), ("file",)) and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = f.value
            yield f  # checked again by Spark: a renamed file has both names in one text

    def _git(self, *arguments: str) -> list[str]:
        return ["git", "-C", self.options["path"], *arguments]

    def partitions(self) -> list[Commits]:
        listed = self._git("rev-list", *([f"--max-count={int(self.options['most'])}"] if "most" in self.options else []), self.options.get("revision", "HEAD"))
        names = subprocess.run(listed, capture_output=True, text=True, check=True).stdout.split()
        if "commit" in self.wanted:
            names = [n for n in names if n == self.wanted["commit"]]
        size = int(self.options.get("commits", "1000"))
        return [Commits(names[a : a + size]) for a in range(0, len(names), size)] or [Commits([])]

    def read(self, partition: Commits) -> Iterator[tuple]:
        if not partition.names:
            return
        # A path limits what git looks at, but hides the other half of a rename: those are told apart by Spark.
        path = ["--", self.wanted["file"]] if "file" in self.wanted and " => " not in self.wanted["file"] else []
        command = self._git("log", "--no-walk=unsorted", "--stdin", "--numstat", f"--format={FORMAT}", *path)
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, errors="replace") as git:
            git.stdin.write("\n".join(partition.names) + "\n")
            git.stdin.close()
            head = None
            for line in git.stdout:
                line = line.rstrip("\n")
                if line.startswith("\x01"):
                    name, author, at, subject = line[1:].split("\x1f", 3)
                    head = name, author, int(at), subject
                elif line.count("\t") >= 2 and head:
                    added, gone, file = line.split("\t", 2)
                    if added.isdigit() and gone.isdigit():
                        yield *head, file, int(added), int(gone)
        if git.returncode:
            raise RuntimeError(f"git log ended with {git.returncode}")
