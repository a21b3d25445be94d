"""Changes of a source tree as a stream: every file that was added, changed or removed, once.

    spark.dataSource.register(TreeChanges)
    spark.readStream.format("tree_changes").option("path", tree).option("state", folder).load()

An offset is the number of a listing kept in the state folder, so that the difference of two
offsets is the same after a restart. The driver lists names, times and sizes; texts are read
by tasks. The tree and the state folder are where the driver and all executors see them."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, bool, int]]):
        super().__init__(len(names))
        self.names = names


class TreeChanges(DataSource):
    """(path, at, sha256, text): a file's state; a null sha256 is a removal.

    ``at`` is the number of the listing that saw the change, so that later states order after
    earlier ones. A text that is no UTF-8 has its bad bytes replaced; a file that goes before it
    is read counts as removed. Options: ``path``; ``state``; ``quiet``, the seconds for which a
    file has to be left alone before it counts (0.3); ``skip``, folder names that are not
    looked into, by commas (.git); ``files`` to a task (500)."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return "path string, at long, sha256 string, text string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.tree, self.state = options["path"], Path(options["state"])
        self.quiet, self.skip = float(options.get("quiet", "0.3")), set(options.get("skip", ".git").split(","))
        self.size = int(options.get("files", "500"))

    def _kept(self, number: int) -> dict[str, list[int]]:
        return json.loads((self.state / f"{number:012d}.json").read_text()) if number else {}

    def _listed(self, before: dict[str, list[int]]) -> dict[str, list[int]]:
        """Time and size of each file; of one that is being written, those it had before."""
        out, now = {}, time.time()
        for folder, folders, names in os.walk(self.tree):
            folders[:] = sorted(set(folders) - self.skip)
            for name in names:
                full = os.path.join(folder, name)
                try:
                    seen = os.stat(full)
                except FileNotFoundError:
                    continue
                path = os.path.relpath(full, self.tree)
                if now - seen.st_mtime >= self.quiet:
                    out[path] = [seen.st_mtime_ns, seen.st_size]
                elif path in before:
                    out[path] = before[path]
        return out

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        self.state.mkdir(parents=True, exist_ok=True)
        number = max((int(p.stem) for p in self.state.glob("*.json")), default=0)
        before = self._kept(number)
        now = self._listed(before)
        if now != before:
            number += 1
            draft = self.state / f".{number}-{os.getpid()}"
            draft.write_text(json.dumps(now))
            draft.replace(self.state / f"{number:012d}.json")
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        before, after = self._kept(start["listing"]), self._kept(end["listing"])
        changed = [(p, p in after, end["listing"]) for p in sorted(before.keys() | after.keys()) if before.get(p) != after.get(p)]
        return [Files(changed[a : a + self.size]) for a in range(0, len(changed), self.size)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, there, at in partition.names:
            try:
                data = Path(self.tree, path).read_bytes() if there else None
            except FileNotFoundError:
                data = None
            yield path, at, data if data is None else hashlib.sha256(data).hexdigest(), data if data is None else data.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        """Drops listings before the one that the next difference starts from."""
        for p in self.state.glob("*.json"):
            if int(p.stem) < end["listing"] - 1:
                p.unlink(missing_ok=True)
