"""Incremental indexing: which files changed, which functions must be resolved again, and a stream that keeps an index up to date.

The stream and the windowed event counts are additions; what decides about re-use and re-runs follows the engine's cache.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (file, sha256, …) that the cache (file, sha256) doesn't hold as they are."""
    return files.join(cache.select("file", "sha256").distinct(), ["file", "sha256"], "left_anti")


def needs_rerun(functions: DataFrame, cache: DataFrame, delta: DataFrame, resolved: DataFrame, unresolved: DataFrame) -> DataFrame:
    """``(fqn, reason)``: functions of changed or new files; callers of removed functions; and functions with an unresolved name in which
    an added function's name ends.

    ``functions``: fqn, file, sha256; ``delta``: fqn, change; ``resolved``: caller, callee; ``unresolved``: caller, target.
    Names are compared by the suffixes of the added names, an equi-join; never by pairs.
    """
    dirty = changed(functions, cache).select("fqn", F.lit("changed").alias("reason"))
    gone = resolved.join(delta.where("change = 'removed'").select(F.col("fqn").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("fqn"), F.lit("callee_removed").alias("reason"))
    parts = F.split("fqn", r"\.")
    suffixes = delta.where("change = 'added'").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("target")).distinct()
    maybe = unresolved.join(suffixes, "target", "left_semi").select(F.col("caller").alias("fqn"), F.lit("may_resolve").alias("reason"))
    return dirty.unionByName(gone).unionByName(maybe).groupBy("fqn").agg(F.min("reason").alias("reason"))


def cache_valid(meta: dict[str, str], root: str, versions: dict[str, str]) -> dict[str, bool]:
    """Which cached tables may be used: none after a change of root, else those of the same version."""
    same_root = meta.get("root") == root
    return {t: same_root and meta.get(t) == v for t, v in versions.items()}


def index_stream(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, parse) -> StreamingQuery:
    """A stream over a directory of file tables (file, content, …): each batch's changed files are parsed and written to the index.

    ``parse`` turns (file, sha256, content) rows into rows with ``file`` and ``sha256``. A batch that is run again after a failure
    replaces its own output, so every batch counts once.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        hashed = batch.withColumn("sha256", F.sha2(F.coalesce("content", F.lit("")), 256)).dropDuplicates(["file", "sha256"])
        try:
            known = spark.read.parquet(index).where(F.col("batch") < number)
            hashed = changed(hashed, known)
        except Exception as e:  # noqa: BLE001 - there is no index yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        parse(hashed).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(index)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows of event time; rows later than ``late`` behind the newest are left out of a stream."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def current_index(index: DataFrame) -> DataFrame:
    """The newest version of each file in an index written batch by batch."""
    newest = index.groupBy("file").agg(F.max("batch").alias("batch"))
    return index.join(newest, ["file", "batch"], "left_semi")


@dataclass
class IndexStatus:
    """What an index build is at, for a caller that asks while it runs: state, phase, and how much of the phase is done."""

    state: str = "uninitialized"  # then indexing, ready or failed
    phase: str = ""
    done: int = 0
    total: int = 0
    message: str = ""
    started: float | None = None
    ended: float | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def begin(self, phase: str, total: int = 0) -> None:
        with self._lock:
            now = time.time()
            self.state, self.phase, self.done, self.total, self.message, self.ended = "indexing", phase, 0, total, "", None
            self.started = self.started or now

    def advance(self, n: int = 1) -> None:
        with self._lock:
            self.done += n

    def finish(self, error: str | None = None) -> None:
        with self._lock:
            self.state, self.message, self.ended = ("failed", error, time.time()) if error else ("ready", "", time.time())

    def report(self) -> dict[str, Any]:
        with self._lock:
            share = 1.0 if self.state == "ready" else min(1.0, self.done / self.total) if self.total else 0.0
            seconds = (self.ended or time.time()) - self.started if self.started else 0.0
            return {"state": self.state, "phase": self.phase, "progress": share, "done": self.done, "total": self.total, "message": self.message, "seconds": round(seconds, 3)}


def index_in_background(build: Callable[[IndexStatus], None], status: IndexStatus) -> threading.Thread:
    """Runs a build in a thread of the driver; ``status`` tells how far it is, and how it ended."""

    def run() -> None:
        try:
            build(status)
            status.finish()
        except Exception as e:  # noqa: BLE001 - whatever ends a build is its status
            status.finish(f"{type(e).__name__}: {e}")

    status.begin("start")
    thread = threading.Thread(target=run, name="index", daemon=True)
    thread.start()
    return thread
