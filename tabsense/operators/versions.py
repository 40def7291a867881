"""Versioned tables: parquet snapshots, an append-only log of manifests, a cursor, and diffs."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import present
from .features import Action

LOG = (
    "event bigint, kind string, version bigint, snapshot string, name string, at timestamp_ntz, rows bigint, columns bigint, "
    "action string, parameters map<string,string>"
)
TRIES = 50


class VersionedTable:
    """A linear history under one folder.

    A commit writes a snapshot under a name of its own and then one manifest,
    ``log/<event>.json``; undo, redo and jump write a manifest only. A manifest is put in
    place by a rename that fails where its number is taken, so of two writers one is told to
    look again and takes the next number. The state is the replay of the manifests, one per
    user action: what a lost driver left behind without a manifest is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- log
    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).json(f"{self.root}/log/*.json")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def _state(self) -> tuple[list, int, int]:
        """(active commits in order, cursor, next event)."""
        history, cursor, event = [], -1, 0
        for e in self.events().orderBy("event").collect():
            event = e["event"] + 1
            if e["kind"] == "commit":
                history = history[: cursor + 1] + [e]
                cursor = len(history) - 1
            else:
                cursor = e["version"]
        return history, cursor, event

    def _put(self, event: int, manifest: dict) -> bool:
        """Whether the manifest now stands under its number; false where another one does."""
        jvm = self.spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs
        draft, final = (fs.Path(f"{self.root}/log/{name}") for name in (f"_draft-{uuid.uuid4().hex}", f"{event:012d}.json"))
        files = fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        system = draft.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = system.create(draft, False)
        out.write(bytearray(json.dumps({"event": event, **manifest}).encode()))
        out.close()
        try:
            # without an option the rename never overwrites
            files.rename(draft, final, self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            system.delete(draft, False)
            return False
        return True

    def _append(self, entry: Callable[[list, int], dict | None]) -> dict | None:
        """Adds what ``entry`` makes of (history, cursor); another writer's manifest is taken in first and ``entry`` asked again."""
        for _ in range(TRIES):
            history, cursor, event = self._state()
            made = entry(history, cursor)
            if made is None:
                return None
            if self._put(event, {**made, "at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()}):
                return made
        raise RuntimeError(f"other writers took the next place {TRIES} times")

    # -- writing
    def commit(self, df: DataFrame, action: Action | None = None, name: str | None = None) -> int:
        """Write a new version after the cursor; versions that were undone fall out of the history."""
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{snapshot}")
        rows = self.spark.read.parquet(f"{self.root}/{snapshot}").count()  # read off the file footers
        text = action.description if action else "Baseline"

        def entry(history: list, cursor: int) -> dict:
            return {
                "kind": "commit", "version": cursor + 1, "snapshot": snapshot, "name": name or (action.description if action else f"Version {cursor + 1}"),
                "rows": rows, "columns": len(df.columns), "action": text, "parameters": dict(action.parameters) if action else {},
            }

        return self._append(entry)["version"]

    # -- reading
    def _move(self, target: Callable[[int], int]) -> int | None:
        history, cursor, _ = self._state()
        if history and target(cursor) == cursor:
            return cursor

        def entry(history: list, cursor: int) -> dict | None:
            return {"kind": "move", "version": target(cursor)} if 0 <= target(cursor) < len(history) else None

        made = self._append(entry)
        return made and made["version"]

    def undo(self) -> int | None:
        return self._move(lambda cursor: cursor - 1)

    def redo(self) -> int | None:
        return self._move(lambda cursor: cursor + 1)

    def jump_to(self, version: int) -> int | None:
        return self._move(lambda cursor: version)

    @property
    def version(self) -> int:
        return self._state()[1]

    @property
    def can_undo(self) -> bool:
        return self._state()[1] > 0

    @property
    def can_redo(self) -> bool:
        history, cursor, _ = self._state()
        return cursor < len(history) - 1

    def read(self, version: int | None = None) -> DataFrame:
        history, cursor, _ = self._state()
        at = cursor if version is None else version
        if not 0 <= at < len(history):
            raise ValueError(f"No version {at}")
        return self.spark.read.parquet(f"{self.root}/{history[at]['snapshot']}")

    def audit_log(self) -> DataFrame:
        """One row per version of the current history."""
        history, cursor, _ = self._state()
        rows = [
            (i, e["name"], e["at"], e["rows"], e["columns"], i == cursor, e["action"], e["parameters"])
            for i, e in enumerate(history)
        ]
        return self.spark.createDataFrame(
            rows, "version bigint, name string, at timestamp_ntz, rows bigint, columns bigint, is_current boolean, "
            "action string, parameters map<string,string>",
        )


def _size(df: DataFrame, suffix: str) -> DataFrame:
    nulls = [F.count_if(present(df, c).isNull()) for c in df.columns]
    missing = sum(nulls[1:], nulls[0]) if nulls else F.lit(0)
    return df.agg(F.count(F.lit(1)).alias(f"rows_{suffix}"), missing.cast("bigint").alias(f"missing_{suffix}"))


def dataset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of deltas between two tables; one aggregate per side."""
    old, new = set(before.columns), set(after.columns)
    both = _size(before, "before").crossJoin(F.broadcast(_size(after, "after")))
    wide = lambda x: F.lit(x).cast("bigint")
    return both.select(
        "rows_before", "rows_after", (F.col("rows_after") - F.col("rows_before")).alias("rows_delta"),
        wide(len(before.columns)).alias("cols_before"), wide(len(after.columns)).alias("cols_after"),
        wide(len(after.columns) - len(before.columns)).alias("cols_delta"),
        F.lit(", ".join(sorted(new - old))).alias("columns_added"),
        F.lit(", ".join(sorted(old - new))).alias("columns_removed"),
        "missing_before", "missing_after", (F.col("missing_after") - F.col("missing_before")).alias("missing_delta"),
    )
