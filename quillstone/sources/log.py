"""Record tables as segments of changes: writes in proportion to what changes, versions that one of two writers gets.

A version is a small file that lists segments, oldest first; the next one is
published by putting a file of its number where none is. A writer that comes
second sees it, takes the new state into account and tries again. Reads merge:
of each key the last segment's row stands. Segments are merged by size, so that a
row is written a few times in all, however many writes there are.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources import records
from quillstone.sources.tables import _drop, cut, names_in, put_if_absent

#: Segments of like size that are merged into one, and how often a writer that came second tries again.
MERGED, TRIES = 4, 50
#: Marks rows of keys that are gone.
REMOVED = "removed_"


class Conflict(RuntimeError):
    """Other writers were first, again and again."""


class Log:
    """Rows by ``keys``, of each key the last one written, or the one that is greatest by ``order``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str | None = None):
        self.spark, self.path, self.keys, self.order = spark, path, list(keys), order

    def version(self) -> int:
        """The newest version's number, 0 before the first write."""
        return max((int(n[:-5]) for n in names_in(self.spark, f"{self.path}/versions") if n.endswith(".json")), default=0)

    def segments(self, version: int | None = None) -> list[dict]:
        """name and rows of a version's segments."""
        version = self.version() if version is None else version
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{version}.json").collect())) if version else []

    def _publish(self, version: int, segments: list[dict]) -> bool:
        return put_if_absent(self.spark, f"{self.path}/versions/{version}.json", json.dumps(segments))

    def _merged(self, segments: list[dict]) -> DataFrame:
        """The row of each key that stands in these segments, with removed_."""
        parts = [self.spark.read.parquet(f"{self.path}/segments/{s['name']}").withColumn("place_", F.lit(k)) for k, s in enumerate(segments)]
        if len(parts) == 1:
            return parts[0].drop("place_")
        rest = [c for c in parts[0].columns if c not in (*self.keys, "place_")]
        by = F.struct(F.col(self.order), "place_") if self.order else F.col("place_")
        last = lambda df: df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), by).alias("row_")).select(*self.keys, "row_.*")
        if self.order:
            return last(functools.reduce(DataFrame.unionByName, parts))
        # the oldest segment is the largest: it is not dealt anew, only what later ones name is left out
        later = last(functools.reduce(DataFrame.unionByName, parts[1:]))
        return parts[0].drop("place_").join(later.select(*self.keys), self.keys, "left_anti").unionByName(later)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the newest unless said; a log that was never written has no columns to give."""
        segments = self.segments(version)
        if not segments:
            raise ValueError(f"nothing was written to {self.path}")
        return self._merged(segments).filter(~F.col(REMOVED)).drop(REMOVED)

    def _write(self, rows: DataFrame, name: str | None = None) -> dict:
        name = name or uuid.uuid4().hex
        path = f"{self.path}/segments/{name}"
        rows.write.mode("overwrite").parquet(path)
        return {"name": name, "rows": self.spark.read.parquet(path).count()}

    def commit(self, make: Callable[[int], DataFrame | None], name: str | None = None) -> int:
        """Publish the rows (with removed_) that ``make`` gives for the version that they build on; its number, or that of the version which has a segment called ``name`` already."""
        for _ in range(TRIES):
            version = self.version()
            segments = self.segments(version)
            if name is not None and any(name in (s["name"], *s.get("of", ())) for s in segments):
                return version
            rows = make(version)
            if rows is None:
                return version
            new = self._write(rows, None if name is None else f"{name}-{uuid.uuid4().hex}") | ({} if name is None else {"of": [name]})
            if self._publish(version + 1, [*segments, new]):
                return version + 1
            _drop(self.spark, f"{self.path}/segments/{new['name']}")
        raise Conflict(self.path)

    def append(self, rows: DataFrame, name: str | None = None) -> int:
        """Rows that stand whatever was there; with a ``name`` they are written once, however often they are given."""
        given = rows.withColumn(REMOVED, F.lit(False))
        return self.commit(lambda _: given, name)

    def settle(self) -> int:
        """Merge the newest segments that are of like size, if there are several; what others write meanwhile stays behind."""
        version = self.version()
        segments = self.segments(version)
        at, total = len(segments), 0
        while at and (total == 0 or segments[at - 1]["rows"] <= 2 * total):
            at -= 1
            total += max(1, segments[at]["rows"])
        return version if len(segments) - at < MERGED else self._replace(version, segments, at)

    def compact(self) -> int:
        """Everything as one segment."""
        version = self.version()
        segments = self.segments(version)
        return version if len(segments) < 2 else self._replace(version, segments, 0)

    def _replace(self, version: int, segments: list[dict], at: int) -> int:
        rows = self._merged(segments[at:])
        new = self._write(rows if at else rows.filter(~F.col(REMOVED)))
        new["of"] = [n for s in segments[at:] for n in s.get("of", ())]
        for _ in range(TRIES):
            now = self.segments(version)
            if now[: len(segments)] != segments:  # another merge was first
                break
            if self._publish(version + 1, [*segments[:at], new, *now[len(segments) :]]):
                return version + 1
            version = self.version()
        _drop(self.spark, f"{self.path}/segments/{new['name']}")
        return self.version()

    def clean(self, versions: int = 2) -> None:
        """Remove what the newest ``versions`` do not name; nobody may read older ones or write meanwhile."""
        newest = self.version()
        kept = {s["name"] for v in range(max(1, newest - versions + 1), newest + 1) for s in self.segments(v)}
        for name in names_in(self.spark, f"{self.path}/segments"):
            if name not in kept:
                _drop(self.spark, f"{self.path}/segments/{name}")
        for v in range(1, newest - versions + 1):
            _drop(self.spark, f"{self.path}/versions/{v}.json")


class Records(Log):
    """A collection: partition_key, id, payload, revision, etag, created_at and updated_at."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, records.KEYS)

    def _held(self, version: int, keys: DataFrame) -> DataFrame:
        """The state of the records that ``keys`` names."""
        return self.read(version).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def upsert(self, changes: DataFrame, payload: list[str], order: str = "seq", at: str = "at") -> int:
        """``records.upsert`` of a state that is there: what is written are the changed records."""
        return self.commit(lambda v: records.upsert(self._held(v, changes), changes, payload, order, at).withColumn(REMOVED, F.lit(False)))

    def put(self, changes: DataFrame, payload: list[str], at: str = "at") -> tuple[int, DataFrame]:
        """Write the changes (one a key, with ``expected``) that ``records.conditional`` allows; the version and each change's status. Two writers that expect the same revision never both succeed."""
        judged = None

        def make(version: int) -> DataFrame | None:
            nonlocal judged
            held = self._held(version, changes)
            judged = cut(records.conditional(held, changes))
            good = judged.filter("status <> 'conflict'")
            if good.isEmpty():
                return None
            made = good.join(held.select(*self.keys, F.col("created_at").alias("since_")), self.keys, "left")
            return made.select(*self.keys, *payload, F.col("revision").cast("bigint").alias("revision"), records.etag(F.col("revision")).alias("etag"), F.coalesce("since_", at).alias("created_at"), F.col(at).alias("updated_at"), F.lit(False).alias(REMOVED))

        version = self.commit(make)
        return version, judged

    def delete(self, keys: DataFrame) -> int:
        """Without the records that ``keys`` names."""
        return self.commit(lambda v: self._held(v, keys).withColumn(REMOVED, F.lit(True)))
