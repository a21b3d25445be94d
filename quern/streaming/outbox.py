"""An event queue for several consumers: parts are claimed for a time, outcomes published under a fence.

Events are hashed by id to parts, so all deliveries of an event meet in one part. A consumer
claims parts that have work, handles their events on the executors and publishes the outcomes.
A claim ends with its lease: another consumer may then claim the part, with a higher fence
number, and what the first one publishes later is refused. Claims and outcomes are states of
one table (``Versions``), so each appears whole, and of two that race one sees the other.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.sources.versions import Versions

PART = "part_no"
OUTCOME = "retry_count int, status string, error_message string, due double, handled_by string"
#: Folders of settled events of a part; with more they are written as one.
MOST_FOLDERS = 8


@dataclass(frozen=True)
class Claim:
    part: int
    fence: int
    inbox: tuple[str, ...]
    settled: tuple[str, ...]
    pending: str | None


class Outbox:
    """The queue in ``path`` of events with the given ``schema``, which has a column id.

    An event that succeeds is PROCESSED; one that fails is PENDING and due again after 2^retries
    seconds, until it has failed ``most`` times: then it is FAILED. PROCESSED and FAILED are for
    good: an id that is put again later changes nothing. Rows without an id are left out. Of rows
    that repeat an id in what a claim covers, one is handled.

    Outcomes count once. A handler may see an event twice: if its task is run again, or if its
    consumer died or outlived its lease. ``parts`` bounds how many consumers work at once, not
    how many tasks; it is fixed when the queue is first put to."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, parts: int = 16, lease: float = 60, most: int = 5, now: Callable[[], float] = time.time):
        self.spark, self.path, self.parts, self.lease, self.most, self.now = spark, path.rstrip("/"), parts, lease, most, now
        self.versions = Versions(spark, path)
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _state(self, state: dict | None) -> dict:
        empty = {"inbox": [], "settled": [], "pending": None, "due": None, "owner": None, "until": 0, "fence": 0}
        return state or {"parts": [dict(empty) for _ in range(self.parts)], "puts": {}}

    def _read(self, folders: list[str], outcome: bool) -> DataFrame:
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        whole = f"{names}, {OUTCOME}" if outcome else names
        return self.spark.read.schema(whole).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], whole)

    def put(self, events: DataFrame, writer: str, number: int) -> None:
        """Adds a batch of events. ``number`` grows by batch of one writer; one that was put before adds nothing."""
        if number <= self._state(self.versions.newest()[1])["puts"].get(writer, -1):
            return
        count = len(self._state(self.versions.newest()[1])["parts"])
        folder = self.versions.new("events")
        placed = events.select(*self.columns).where("id is not null").withColumn(PART, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
        placed.repartition(PART, F.pmod(F.hash("id"), F.lit(8))).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        touched = [int(n.split("=")[1]) for n in self.versions.listed(folder) if n.startswith(f"{PART}=")]

        def step(state: dict | None) -> dict | None:
            state = self._state(state)
            if number <= state["puts"].get(writer, -1):
                self.versions.remove(folder)
                return None
            for p in touched:
                state["parts"][p]["inbox"].append(f"{folder}/{PART}={p}")
            state["puts"][writer] = number
            return state

        self.versions.change(step)

    def claim(self, consumer: str, most_parts: int | None = None) -> list[Claim]:
        """Parts with work that nobody holds, now held by ``consumer`` until its lease ends."""
        got: list[Claim] = []

        def step(state: dict | None) -> dict | None:
            got.clear()
            state, moment = self._state(state), float(self.now())
            for p, part in enumerate(state["parts"]):
                work = part["inbox"] or (part["due"] is not None and part["due"] <= moment)
                if work and (part["owner"] is None or part["until"] <= moment) and (most_parts is None or len(got) < most_parts):
                    part.update(owner=consumer, until=moment + self.lease, fence=part["fence"] + 1)
                    got.append(Claim(p, part["fence"], tuple(part["inbox"]), tuple(part["settled"]), part["pending"]))
            return state if got else None

        self.versions.change(step)
        return got

    def renew(self, claims: list[Claim]) -> list[Claim]:
        """Those of ``claims`` that still hold, with a new lease."""
        held: list[Claim] = []

        def step(state: dict | None) -> dict | None:
            state = self._state(state)
            held[:] = [c for c in claims if state["parts"][c.part]["fence"] == c.fence and state["parts"][c.part]["owner"] is not None]
            for c in held:
                state["parts"][c.part]["until"] = float(self.now()) + self.lease
            return state if held else None

        self.versions.change(step)
        return held

    def handle(self, claims: list[Claim], consumer: str, handler: Callable[[pd.DataFrame], list[str | None]]) -> str:
        """Handles what ``claims`` cover and writes the outcomes to a folder, which counts once ``settle`` names it.

        ``handler`` gets batches of events, with retry_count (how often each has failed), and
        returns an error or None for each."""
        moment, most, columns = float(self.now()), self.most, self.columns
        settled = self._read([f for c in claims for f in c.settled], True)
        pending = self._read([c.pending for c in claims if c.pending], True)
        fresh = self._read([f for c in claims for f in c.inbox], False).dropDuplicates(["id"])
        fresh = fresh.join(settled.select("id").unionAll(pending.select("id")), "id", "left_anti").withColumn("retry_count", F.lit(0))
        todo = fresh.select(*columns, "retry_count").unionAll(pending.where(F.col("due") <= moment).select(*columns, "retry_count"))

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                errors = handler(pdf)
                failed = [e is not None for e in errors]
                pdf["retry_count"] = pdf["retry_count"] + failed
                pdf["status"] = ["PROCESSED" if not f else "FAILED" if t >= most else "PENDING" for f, t in zip(failed, pdf["retry_count"])]
                pdf["error_message"] = errors
                pdf["due"] = moment + 2.0 ** pdf["retry_count"].clip(upper=30)
                pdf["handled_by"] = consumer
                yield pdf

        done = todo.mapInPandas(run, settled.schema).unionAll(pending.where(F.col("due") > moment))
        large = [c for c in claims if len(c.settled) >= MOST_FOLDERS]
        done = done.unionAll(self._read([f for c in large for f in c.settled], True))
        folder, count = self.versions.new("outcomes"), len(self._state(self.versions.newest()[1])["parts"])
        placed = done.withColumn("open", F.col("status") == "PENDING").withColumn(PART, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
        placed.repartition("open", PART, F.pmod(F.hash("id"), F.lit(8))).write.partitionBy("open", PART).parquet(f"{self.path}/{folder}")
        return folder

    def settle(self, claims: list[Claim], folder: str) -> list[Claim]:
        """Publishes the outcomes in ``folder`` of those ``claims`` that nobody has claimed since, and returns these."""
        there = {kind: set(self.versions.listed(f"{folder}/open={kind}")) for kind in ("true", "false")}
        due = {}
        if there["true"]:
            open_ = self.spark.read.parquet(f"{self.path}/{folder}/open=true")
            due = {r[PART]: r["due"] for r in open_.groupBy(PART).agg(F.min("due").alias("due")).collect()}  # at most ``parts`` rows
        counted: list[Claim] = []

        def step(state: dict | None) -> dict | None:
            state = self._state(state)
            counted[:] = [c for c in claims if state["parts"][c.part]["fence"] == c.fence and state["parts"][c.part]["owner"] is not None]
            for c in counted:
                part, name = state["parts"][c.part], f"{PART}={c.part}"
                part["inbox"] = [f for f in part["inbox"] if f not in c.inbox]
                part["settled"] = ([] if len(c.settled) >= MOST_FOLDERS else part["settled"]) + ([f"{folder}/open=false/{name}"] if name in there["false"] else [])
                part["pending"] = f"{folder}/open=true/{name}" if name in there["true"] else None
                part.update(due=due.get(c.part), owner=None, until=0)
            return state if counted else None

        self.versions.change(step)
        return list(counted)

    def consume(self, consumer: str, handler: Callable[[pd.DataFrame], list[str | None]], most_parts: int | None = None) -> int:
        """Claims, handles and settles once; the number of parts settled (0: nothing to do, or all claims lost)."""
        claims = self.claim(consumer, most_parts)
        return len(self.settle(claims, self.handle(claims, consumer, handler))) if claims else 0

    def events(self) -> DataFrame:
        """All events put, with status (NEW before the first try), retry_count, error_message and who handled them last."""
        parts = self._state(self.versions.newest()[1])["parts"]
        known = self._read([f for p in parts for f in p["settled"]] + [p["pending"] for p in parts if p["pending"]], True)
        fresh = self._read([f for p in parts for f in p["inbox"]], False).dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti").select(*self.columns)
        fresh = fresh.select("*", F.lit(0).alias("retry_count"), F.lit("NEW").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("handled_by"))
        return known.drop("due").unionByName(fresh)

    def sweep(self, age: float) -> None:
        """Removes states and folders that the newest state doesn't need and that are older than
        ``age`` seconds by their file system's clock: no reader or consumer should take longer."""
        newest, state = self.versions.newest()
        parts = self._state(state)["parts"]
        named = {"/".join(f.split("/")[:2]) for p in parts for f in [*p["inbox"], *p["settled"], *([p["pending"]] if p["pending"] else [])]}
        old = [f"data/{n}" for n in self.versions.listed("data") if f"data/{n}" not in named] + [f"states/{n:012d}" for n in self.versions.numbers() if n < newest]
        self.versions.remove(*[n for n in old if self.versions.age(n) > age])
