"""Collection policies, kept as JSON beside the tables, and search projections of collections."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.filters import Paths
from quillstone.sources.records import KEYS, snapshot
from quillstone.sources.tables import cut

DISTANCES = ("cosine", "dotproduct", "euclidean")
INDEXES = ("flat", "quantizedflat", "diskann")


@dataclass(frozen=True)
class VectorPolicy:
    name: str
    dims: int
    distance: str = "cosine"
    index: str = "flat"

    def __post_init__(self):
        if self.dims <= 0 or self.distance.lower() not in DISTANCES or self.index.lower() not in INDEXES:
            raise ValueError(f"not valid: {self}")


@dataclass(frozen=True)
class Policy:
    """A collection's declared schema: promoted metadata become typed columns, vectors are searched exactly whatever their index."""

    name: str
    partition_path: str = "/partitionKey"
    vectors: tuple[VectorPolicy, ...] = ()
    indexed: tuple[str, ...] = ()

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_-]+", self.name):
            raise ValueError(f"not a collection name: {self.name!r}")

    def normal(self) -> tuple:
        """Equal for policies that differ in order and case alone."""
        return self.name, self.partition_path, frozenset((v.name, v.dims, v.distance.lower(), v.index.lower()) for v in self.vectors), frozenset(self.indexed)

    def paths(self, body: str = "body") -> Paths:
        return Paths({"/id": "id", "/partitionKey": "partition_key", "/updatedAt": "updated_at", "/revision": "revision", **{p: p.rsplit("/", 1)[-1] for p in self.indexed}}, body)


class Conflict(ValueError):
    pass


@dataclass
class Catalog:
    """Policies and table folders under a root that Spark can read and write."""

    spark: SparkSession
    root: str
    held: dict[str, Policy] = field(default_factory=dict)

    def _file(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/collections.json")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def load(self) -> Catalog:
        system, path = self._file()
        if system.exists(path):
            lines = self.spark.read.text(path.toString()).collect()
            for item in json.loads("\n".join(r[0] for r in lines)):
                self.held[item["name"]] = Policy(item["name"], item["partition_path"], tuple(VectorPolicy(**v) for v in item["vectors"]), tuple(item["indexed"]))
        return self

    def _save(self) -> None:
        system, path = self._file()
        out = system.create(path, True)
        out.write(bytearray(json.dumps([asdict(p) for _, p in sorted(self.held.items())]).encode()))
        out.close()

    def create(self, policy: Policy) -> bool:
        """True if new; the same policy again changes nothing, another one of the name conflicts."""
        old = self.held.get(policy.name)
        if old is not None:
            if old.normal() != policy.normal():
                raise Conflict(policy.name)
            return False
        self.held[policy.name] = policy
        self._save()
        return True

    def names(self) -> list[str]:
        return sorted(self.held)

    def drop(self, name: str) -> None:
        del self.held[name]
        self._save()
        system, path = self._file()
        system.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.table_path(name)), True)

    def table_path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, records: DataFrame, row_group_bytes: int = 32 << 20) -> None:
        """The collection's next state, in folders by partition key, so that a filter on it prunes files.

        What the policy indexes is skipped over within files: rows are clustered
        by the first indexed column, whose ranges then meet few row groups and
        pages, and all indexed columns have Bloom filters for equality.
        """
        policy = self.held.get(name)
        indexed = [c for c in (policy.paths().columns[p] for p in policy.indexed) if c in records.columns] if policy else []
        rows = records.withColumn("partition_", F.col("partition_key"))
        if indexed:
            order = ["partition_", indexed[0], *KEYS]
            rows = cut(rows).repartitionByRange(*order).sortWithinPartitions(*order)
        out = rows.write.mode("overwrite").partitionBy("partition_").option("parquet.block.size", row_group_bytes)
        for column in indexed:
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
        out.parquet(self.table_path(name))

    def import_snapshot(self, target: str, policy: Policy, records: DataFrame, columns: list[str], record_count: int | None = None, content_hash: str | None = None, truncated: bool = False, allow_rename: bool = False, allow_partial: bool = False, replace_existing: bool = False) -> dict:
        """Write a snapshot's records as a collection and say what became of its policy: created, replaced or existing_equivalent.

        A snapshot of another name, one cut short, and one whose records are not
        as many or have not the hash that it declares are refused, unless the
        first two are allowed.
        """
        if policy.name != target and not allow_rename:
            raise ValueError(f"the snapshot is of {policy.name!r}, not of {target!r}")
        if truncated and not allow_partial:
            raise ValueError("the snapshot is truncated")
        found = snapshot(records, columns, collection=policy.name, policy=json.loads(json.dumps(asdict(policy)))).first()
        if record_count is not None and found.record_count != record_count or content_hash is not None and found.content_hash != content_hash:
            raise ValueError("the snapshot's records are not those that it declares")
        renamed = replace(policy, name=target)
        old, status = self.held.get(target), "created"
        if old is not None and replace_existing:
            self.drop(target)
            status = "replaced"
        elif old is not None:
            status = "existing_equivalent"
        self.create(renamed)
        kept = records
        if status == "existing_equivalent":
            # what the snapshot does not hold stays
            there = cut(self.read(target))
            kept = there.join(records.select(*KEYS), KEYS, "left_anti").unionByName(records)
        self.write(target, kept)
        return {"policy_status": status, "record_count": found.record_count, "content_hash": found.content_hash}

    def read(self, name: str, partitions: list[str] | None = None) -> DataFrame:
        found = self.spark.read.parquet(self.table_path(name))
        return (found.filter(F.col("partition_").isin(*partitions)) if partitions else found).drop("partition_")


def project(index: DataFrame, changes: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """The search projection after changes (keys, payload, seq, kind): the last change of a key decides, a delete removes it."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("kind", *payload), "seq").alias("c"))
    kept = index.join(last.select(*keys), keys, "left_anti").select(*keys, *payload)
    return kept.unionByName(last.filter("c.kind <> 'delete'").select(*keys, *(F.col(f"c.{p}").alias(p) for p in payload)))


def hydrate(hits: DataFrame, primary: DataFrame, keys: list[str]) -> DataFrame:
    """Hits with the primary's records; hits whose record is gone are left out."""
    return hits.join(primary, keys)
