"""Vectors kept with what they were made of, so that a text that did not change is not embedded again.

A store is a folder of segments. Each holds the keys that it names, of records
that are new, changed or gone, and the vectors of those that are there by the
hash of their text; later segments replace earlier ones. A refresh writes what
changed, and embeds the texts that no segment has a vector of, each once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.tables import cut


@dataclass(frozen=True)
class StoredVectors:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    segments: int = 0

    def _read(self, kind: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{k}/{kind}").withColumn("segment", F.lit(k)) for k in range(self.segments)]
        return functools.reduce(DataFrame.unionByName, parts)

    def rows(self) -> DataFrame:
        """keys, hash and vector of every record as of the last refresh."""
        held = self._read("rows")
        if self.segments > 1:
            last = self._read("named").groupBy(*self.keys).agg(F.max("segment").alias("segment"))
            held = held.join(last, [*self.keys, "segment"], "left_semi")
        return held.drop("segment")

    def embedded(self) -> DataFrame:
        """segment and n: how many texts each refresh embedded."""
        return self._read("made").groupBy("segment").agg(F.sum("n").alias("n"))

    def refresh(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> StoredVectors:
        """The store of ``texts`` (keys, text; null is empty). ``embed`` gives hash and vector of distinct texts (hash, text)."""
        keys, folder = list(self.keys), f"{self.path}/{self.segments}"
        now = texts.select(*keys, F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
        if self.segments:
            held = self.rows()
            changed = cut(now.join(held.select(*keys, "hash"), [*keys, "hash"], "left_anti"))
            gone = held.join(now.select(*keys), keys, "left_anti").select(*keys)
            known = held.select("hash", "vector").join(changed.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
            todo = changed.join(known.select("hash"), "hash", "left_anti")
        else:
            changed, gone, known, todo = now, now.select(*keys).limit(0), None, now
        # a text that many records have is embedded once
        made = cut(embed(todo.groupBy("hash").agg(F.first("text").alias("text"))).select("hash", "vector"))
        vectors = made if known is None else made.unionByName(known)
        changed.select(*keys).unionByName(gone).distinct().write.mode("overwrite").parquet(f"{folder}/named")
        changed.select(*keys, "hash").join(vectors, "hash").select(*keys, "hash", "vector").write.mode("overwrite").parquet(f"{folder}/rows")
        made.agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/made")
        return StoredVectors(self.spark, self.path, self.keys, self.segments + 1)

    def compacted(self, path: str) -> StoredVectors:
        """The same store as one segment."""
        rows = self.rows()
        rows.write.mode("overwrite").parquet(f"{path}/0/rows")
        rows.select(*self.keys).write.mode("overwrite").parquet(f"{path}/0/named")
        self.spark.createDataFrame([(0,)], "n bigint").write.mode("overwrite").parquet(f"{path}/0/made")
        return StoredVectors(self.spark, path, self.keys, 1)
