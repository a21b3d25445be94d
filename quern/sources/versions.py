"""Tables as numbered states: folders of data and a small JSON file that says which count.

A state appears whole and at once, and only if no other writer has taken its number, so
readers never see half a change and writers that race don't undo each other's."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Versions:
    """States of the table in ``folder``; the newest number counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._paths.Path(self.folder).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._paths.Path(f"{self.folder}/{name}")

    def listed(self, name: str = "states") -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.listed() if n.isdigit())

    def at(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"states/{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict | None]:
        """Number and state; (0, None) where there is none yet."""
        numbers = self.numbers()
        return (numbers[-1], self.at(numbers[-1])) if numbers else (0, None)

    def publish(self, number: int, state: dict) -> bool:
        """False if that number is taken."""
        draft, target = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"states/{number:012d}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # whose rename replaces what is there
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            context = self._paths.FileContext.getFileContext(self._fs.getUri(), self._conf)
            option = self.spark.sparkContext._gateway.new_array(getattr(self._paths, "Options$Rename"), 1)
            option[0] = getattr(self._paths, "Options$Rename").NONE
            context.rename(draft, target, option)
            return True
        except Exception:
            if not self._fs.exists(target):
                raise
            return False
        finally:
            self._fs.delete(draft, False)

    def change(self, step: Callable[[dict | None], dict | None]) -> int:
        """Publishes what ``step`` makes of the newest state (None: no change) and returns its
        number. A writer that loses a race calls ``step`` again on the winner's state."""
        while True:
            number, state = self.newest()
            after = step(state)
            if after is None:
                return number
            if self.publish(number + 1, after):
                return number + 1

    def remove(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(name), True)

    def age(self, name: str) -> float:
        """Seconds since a file or folder of the table was last written."""
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def new(self, kind: str) -> str:
        """Name of a new data folder, relative to the table's."""
        return f"data/{kind}-{uuid.uuid4().hex}"
