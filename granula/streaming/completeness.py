"""Objects as streaming state: file rows are kept by object until all declared entities are there.

A row of the stream names an object, one of its entities and what tells versions of that file
apart (its length and time). The state of an object holds the newest version of each entity,
in a map of one small value for each, and the fingerprint under which it was last passed on:
an object is passed on when it is complete, and again when a file of a complete object changes,
but not when a row is repeated. An object that stays incomplete for ``wait`` sets off a timer and
is named once with what it lacks, by the next batch that has rows. State is checkpointed with the query, so a run
that is started again goes on where the last one ended, late files included.

Defined results: rows without object or entity are dropped; entities that are not declared
are kept with the object but not waited for; older versions of a file that arrive late change
nothing; an object without declared entities is complete with its first file.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the state of the streams needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES = "object_key string, entity string, path string, length long, modified timestamp, declared array<string>"
FOUND = "object_key string, status string, fingerprint string, entities string, missing string"


def fingerprint(files: dict[str, tuple[str, int, int]]) -> str:
    """A digest of the versions of an object's files, whatever their order."""
    return hashlib.sha256(json.dumps(sorted((k, *v) for k, v in files.items())).encode()).hexdigest()[:16]


class Completeness(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "entity string", "path string, length long, modified long")
        self.wanted = handle.getValueState("wanted", "names string")
        self.said = handle.getValueState("said", "fingerprint string")

    def _held(self) -> dict[str, tuple[str, int, int]]:
        return {k[0]: tuple(v) for k, v in self.files.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = set(json.loads(self.wanted.get()[0])) if self.wanted.exists() else set()
        held = self._held()
        for batch in rows:
            for r in batch.itertuples(index=False):
                names |= set(r.declared if r.declared is not None else [])
                version = (str(r.path), int(r.length), int(r.modified.value // 1000) if pd.notna(r.modified) else 0)
                if r.entity not in held or held[r.entity][2] < version[2] or (held[r.entity][2] == version[2] and held[r.entity] < version):
                    held[r.entity] = version
                    self.files.updateValue((r.entity,), version)
        self.wanted.update((json.dumps(sorted(names)),))
        missing, last = names - held.keys(), self.said.get()[0] if self.said.exists() else None
        if not missing and (now := fingerprint(held)) != last:
            self.said.update((now,))
            self._stop()
            yield self._row(key, "complete", now, held, missing)
        elif missing and last is None and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        names = set(json.loads(self.wanted.get()[0])) if self.wanted.exists() else set()
        if names - held.keys():
            yield self._row(key, "incomplete", None, held, names - held.keys())

    def _stop(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _row(self, key, status, mark, held, missing) -> pd.DataFrame:
        return pd.DataFrame([(key[0], status, mark, json.dumps(sorted(held)), json.dumps(sorted(missing)) if missing else None)], columns=["object_key", "status", "fingerprint", "entities", "missing"])

    def close(self) -> None:
        pass


def complete_objects(files: DataFrame, wait_seconds: float = 3600.0) -> DataFrame:
    """(object_key, status, fingerprint, entities, missing) of a stream of file rows, as of FILES: objects as they become complete or change, and those that wait too long."""
    rows = files.where(F.col("object_key").isNotNull() & F.col("entity").isNotNull()).select("object_key", "entity", "path", "length", "modified", "declared")
    return rows.groupBy("object_key").transformWithStateInPandas(statefulProcessor=Completeness(int(wait_seconds * 1000)), outputStructType=FOUND, outputMode="Append", timeMode="ProcessingTime")


def run_available(spark: SparkSession, listing: str, land: Callable[[DataFrame, int], None], checkpoint: str, wait_seconds: float = 3600.0) -> None:
    """Take what is new in a folder of JSON lines (as of FILES) into the state and hand each batch of found objects to ``land``."""
    # batches without rows would run on for ever while a timer waits
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        found = complete_objects(spark.readStream.schema(FILES).json(listing), wait_seconds)
        found.writeStream.outputMode("append").foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
