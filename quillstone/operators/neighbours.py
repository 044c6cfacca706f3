"""Approximate nearest neighbours: layered proximity graphs by shard, and inverted lists of residual codes.

Both look for Euclidean nearness. Cosine is that on the unit sphere; a dot product
becomes it with one coordinate more, which brings all vectors of an index to one
norm. Scores that come back are computed from the vectors themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators.vector import BLOCK, ROWS, _matrix, _packed, index_choice, top_k, valid
from quillstone.sources.tables import cut

#: Numbers of an intermediate matrix, about.
CELLS = 1 << 22


def _placed(points: np.ndarray, distance: str, radius: float = 0.0) -> np.ndarray:
    """Where stored vectors stand: on the unit sphere for cosine, on one of ``radius`` for dot products."""
    if distance == "cosine":
        size = np.linalg.norm(points, axis=1, keepdims=True)
        return np.divide(points, size, out=np.zeros_like(points), where=size > 0)
    if distance == "dotproduct":
        return np.column_stack([points, np.sqrt(np.maximum(radius**2 - (points**2).sum(axis=1), 0))])
    return points


def _looked_up(queries: np.ndarray, distance: str) -> np.ndarray:
    return np.column_stack([queries, np.zeros(len(queries))]) if distance == "dotproduct" else _placed(queries, distance)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all of a to all of b."""
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def _good(vectors: DataFrame, dims: int) -> DataFrame:
    return vectors.filter(valid(F.col("vector"), dims)).select("id", F.col("vector").cast("array<double>").alias("vector"))


def _asked(queries: DataFrame, dims: int) -> DataFrame:
    return queries.filter(valid(F.col("vector"), dims)).select(F.col("query_id").alias("id"), F.lit(0).alias("grp"), F.col("vector").cast("array<double>").alias("vector"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def linked(points: np.ndarray, m: int, width: int) -> np.ndarray:
    """Links of a layer (a row a point, -1 for none): of each point's ``width`` nearest those that are not nearer to one taken before, ``m`` at most, and the links back, 2 m in all."""
    n = len(points)
    width = min(width, n - 1)
    if width < 1:
        return np.full((n, 1), -1, np.int32)
    ends, gaps = [], []
    step = max(1, CELLS // max(n, width * points.shape[1]))
    for at in range(0, n, step):
        own = np.arange(at, min(n, at + step))
        apart = _apart(points[own], points)
        apart[np.arange(len(own)), own] = np.inf
        near = np.argpartition(apart, width - 1, axis=1)[:, :width]
        gap = np.take_along_axis(apart, near, 1)
        order = np.argsort(gap, axis=1, kind="stable")
        near, gap = np.take_along_axis(near, order, 1), np.take_along_axis(gap, order, 1)
        ends.append(_spread(points, near, gap, m))
        gaps.append(gap)
        ends[-1] = np.where(ends[-1], near, -1)
    to, gap = np.concatenate(ends), np.concatenate(gaps)
    u, k = np.nonzero(to >= 0)
    v, d = to[u, k], gap[u, k]
    # both directions, nearest first, each once
    a, b, d = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([d, d])
    _, first = np.unique(a * np.int64(n) + b, return_index=True)
    a, b, d = a[first], b[first], d[first]
    order = np.lexsort((d, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    links = np.full((n, 2 * m), -1, np.int32)
    kept = place < 2 * m
    links[a[kept], place[kept]] = b[kept]
    return links


def _spread(points: np.ndarray, near: np.ndarray, gap: np.ndarray, m: int) -> np.ndarray:
    """Which of each row's neighbours, nearest first, to link to: none that is nearer to a taken one than to the point, and the nearest of the others while there is room."""
    taken = np.zeros(near.shape, bool)
    step = max(1, CELLS // (near.shape[1] * max(near.shape[1], points.shape[1])))
    for at in range(0, len(near), step):
        part = points[near[at : at + step]]
        norms = (part**2).sum(axis=2)
        between = norms[:, :, None] + norms[:, None, :] - 2 * part @ part.transpose(0, 2, 1)
        own, mine = taken[at : at + step], gap[at : at + step]
        for j in range(near.shape[1]):
            hidden = (own & (between[:, j, :] < mine[:, j, None])).any(axis=1)
            own[:, j] = ~hidden & (own.sum(axis=1) < m)
    room = m - taken.sum(axis=1)
    spare = ~taken & (np.cumsum(~taken, axis=1) <= room[:, None])
    return taken | spare


class Layers:
    """A shard's graph: every point in the lowest layer, one in ``m`` of a layer's points in the next."""

    def __init__(self, points: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]):
        self.points, self.links, self.norms = points, links, (points**2).sum(axis=1)

    @classmethod
    def of(cls, points: np.ndarray, m: int, width: int, seed: int = 1) -> Layers:
        rng, members, links = np.random.default_rng(seed), np.arange(len(points)), []
        while True:
            links.append((members.astype(np.int32), linked(points[members], m, width)))
            if len(members) <= width:
                return cls(points, links)
            members = np.sort(rng.choice(members, max(1, len(members) // m), replace=False))

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's best ``ef`` points with their squared distances, nearest first (-1 where there are fewer), and how many points were looked at."""
        looked = np.zeros(len(queries), np.int64)
        entries = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.links) - 1, -1, -1):
            members, links = self.links[k]
            found, gaps, seen = self._beam(queries, members, links, entries, ef if k == 0 else max(1, min(ef, 8)))
            looked += seen
            if k:
                below = self.links[k - 1][0]
                entries = np.where(found >= 0, np.searchsorted(below, members[np.maximum(found, 0)]), -1)
        return np.where(found >= 0, self.links[0][0][np.maximum(found, 0)], -1), gaps, looked

    def _gaps(self, queries: np.ndarray, members: np.ndarray, at: np.ndarray) -> np.ndarray:
        where = members[np.maximum(at, 0)]
        gaps = (queries**2).sum(axis=1)[:, None] + self.norms[where] - 2 * np.einsum("qd,qkd->qk", queries, self.points[where])
        return np.where(at >= 0, gaps, np.inf)

    def _beam(self, queries: np.ndarray, members: np.ndarray, links: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best-first search of all queries at once: each step opens every query's nearest point that is not open yet, until the best ``ef`` are."""
        n, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((n, len(members) + 1), bool)  # the last place is that of no point
        seen[:, -1] = True
        found = np.full((n, ef), -1, np.int64)
        gaps, opened = np.full((n, ef), np.inf), np.zeros((n, ef), bool)
        looked = np.zeros(n, np.int64)
        fresh, active = entries, rows
        while len(active):
            new = ~seen[active[:, None], fresh]
            # a point that two entries name counts once
            order = np.sort(np.where(new, fresh, -1), axis=1)
            fresh = np.where((order >= 0) & (np.diff(order, axis=1, prepend=-2) != 0), order, -1)
            seen[active[:, None], fresh] = True
            looked[active] += (fresh >= 0).sum(axis=1)
            every = np.concatenate([found[active], fresh], axis=1)
            far = np.concatenate([gaps[active], self._gaps(queries[active], members, fresh)], axis=1)
            done = np.concatenate([opened[active], np.zeros(fresh.shape, bool)], axis=1)
            best = np.argsort(far, axis=1, kind="stable")[:, :ef]
            found[active], gaps[active], opened[active] = (np.take_along_axis(x, best, 1) for x in (every, far, done))
            waiting = ~opened[active] & (found[active] >= 0)
            active, waiting = active[waiting.any(axis=1)], waiting[waiting.any(axis=1)]
            next_ = waiting.argmax(axis=1)
            opened[active, next_] = True
            fresh = links[found[active, next_]].astype(np.int64)
        return found, gaps, looked


class Graphs:
    """Vectors dealt into shards by their ids, each with a graph of layers; a query is answered by all shards and the best are merged.

    A shard is one row of Parquet: ids, vectors and links as they lie in memory.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.dims, self.distance, self.radius, self.m, self.width = (about[k] for k in ("dims", "distance", "radius", "m", "ef_construction"))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, dims: int = 64, distance: str = "cosine", m: int = 16, ef_construction: int = 64, shard_rows: int = 1 << 15) -> Graphs:
        """vectors: id and vector. Shards hold about ``shard_rows``, each built by one task."""
        spark = vectors.sparkSession
        good = _good(vectors, dims)
        about = good.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()
        shards = max(1, -(-about[0] // shard_rows))
        radius = float(about[1] or 0.0) ** 0.5
        kind = good.schema["id"].dataType.simpleString()

        def run(key: tuple, table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            points = _matrix(table.column("vector").chunk(0), dims) if table.num_rows else np.zeros((0, dims))
            graph = Layers.of(_placed(points, distance, radius).astype(np.float32), m, ef_construction)
            ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("id").chunk(0))
            members = [x.astype("<i4").tobytes() for x, _ in graph.links]
            links = [x.astype("<i4").tobytes() for _, x in graph.links]
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "ids": ids, "body": pa.array([points.astype("<f8").tobytes()], pa.binary()), "members": pa.array([members], pa.list_(pa.binary())), "links": pa.array([links], pa.list_(pa.binary()))})

        dealt = good.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        dealt.groupBy("shard").applyInArrow(run, f"shard int, ids array<{kind}>, body binary, members array<binary>, links array<binary>").write.mode("overwrite").parquet(f"{path}/shards")
        text = json.dumps({"dims": dims, "distance": distance, "radius": radius, "m": m, "ef_construction": ef_construction})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return cls(spark, path)

    def candidates(self, queries: DataFrame, k: int, ef: int) -> DataFrame:
        """query_id, id, score and looked (vectors of the shard that were scored) of each shard's best ``k``."""
        dims, distance, radius = self.dims, self.distance, self.radius
        asked = _asked(queries, dims)
        blocks = cut(_packed(asked, BLOCK, dims, "q"))
        shards = self.spark.read.parquet(f"{self.path}/shards")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    row = {name: batch.column(name).slice(n, 1) for name in batch.schema.names}
                    ids, names = row["ids"].flatten(), row["q_ids"].flatten()
                    points, q = (np.frombuffer(row[c][0].as_py(), "<f8").reshape(-1, dims) for c in ("body", "q_body"))
                    layers = [(np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4").reshape(len(a) // 4, -1)) for a, b in zip(row["members"][0].as_py(), row["links"][0].as_py(), strict=True)]
                    graph = Layers(_placed(points, distance, radius).astype(np.float32), layers)
                    # so many queries at a time that the marks of what was seen stay small
                    step = max(1, 8 * CELLS // (len(points) + 1))
                    for at in range(0, len(q), step):
                        found, _, looked = graph.search(_looked_up(q[at : at + step], distance).astype(np.float32), max(ef, k))
                        found = found[:, :k]
                        a, b = np.nonzero(found >= 0)
                        place = found[a, b]
                        values = _pairwise(points[place], q[at + a], distance)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(at + a)), ids.take(pa.array(place)), pa.array(values), pa.array(looked[a])], names=["query_id", "id", "score", "looked"])

        kinds = f"query_id {asked.schema['id'].dataType.simpleString()}, id {shards.schema['ids'].dataType.elementType.simpleString()}, score double, looked bigint"
        return shards.join(blocks, how="cross").select("ids", "body", "members", "links", "q_ids", "q_body").mapInArrow(run, kinds)

    def search(self, queries: DataFrame, k: int = 10, ef: int = 64) -> DataFrame:
        """query_id, id, score and rank of each query's best, approximately; a larger ``ef`` looks at more."""
        return _ranked(self.candidates(queries, k, ef).drop("looked"), k)


def _pairwise(a: np.ndarray, b: np.ndarray, distance: str) -> np.ndarray:
    """Scores of rows of a and b one by one."""
    dot = np.einsum("nd,nd->n", a, b)
    if distance == "dotproduct":
        return dot
    if distance == "cosine":
        both = np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1))
        return np.divide(dot, both, out=np.zeros_like(dot), where=both > 0)
    return 1 / (1 + np.sqrt(((a - b) ** 2).sum(axis=1)))


def _centres(points: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from evenly chosen points; of fewer points than ``n`` each is a centre."""
    centres = points[:: max(1, len(points) // n)][:n].copy()
    for _ in range(rounds):
        nearest = _apart(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        count = np.bincount(nearest, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _runs(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows (list, id, body) sorted by list as blocks of one list: ids, and bodies one behind another."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(lists[1:] != lists[:-1]) + 1, [len(lists)]]) if len(lists) else [0, 0]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                for at in range(first, last, size):
                    part = batch.slice(at, min(size, last - at))
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), ids, pa.array([b"".join(part.column(2).to_pylist())], pa.binary())], names=["list", f"{prefix}_ids", f"{prefix}_body"])

    return rows.select("list", "id", "body").mapInArrow(run, f"list int, {prefix}_ids array<{kind}>, {prefix}_body binary")


class CodedLists:
    """Inverted lists of codes: a vector is the centre of its list and, piece by piece, one of 256 residuals.

    Centres and residuals are fitted on a bounded sample, the ``sample`` vectors
    of least hash of their ids. A query looks through the codes of its nearest
    lists by a table of distances per piece; only the vectors that come out best
    are read and scored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.dims, self.distance, self.radius = about["dims"], about["distance"], about["radius"]
        self.centres, self.codes = np.array(about["centres"]), [np.array(c) for c in about["codes"]]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, dims: int = 64, lists: int = 100, distance: str = "cosine", piece: int = 4, sample: int = 20_000, rounds: int = 10) -> CodedLists:
        """vectors: id and vector. ``piece`` coordinates share a byte."""
        spark, good = vectors.sparkSession, _good(vectors, dims)
        radius = float(good.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0) ** 0.5
        some = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column(0).combine_chunks()
        points = _placed(_matrix(some, dims) if len(some) else np.zeros((1, dims)), distance, radius)
        centres = _centres(points, lists, rounds)
        left = points - centres[_apart(points, centres).argmin(axis=1)]
        codes = [_centres(left[:, at : at + piece], 256, rounds) for at in range(0, points.shape[1], piece)]
        text = json.dumps({"dims": dims, "distance": distance, "radius": radius, "centres": centres.tolist(), "codes": [c.tolist() for c in codes]})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        found = cls(spark, path)
        # whole vectors lie by a hash of their ids, so that few are found without a shuffle of all
        good.repartition("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/vectors")
        coded = found._coded(spark.read.parquet(f"{path}/vectors"))
        _runs(cut(coded).repartitionByRange("list", "id").sortWithinPartitions("list", "id"), ROWS, "v").write.mode("overwrite").parquet(f"{path}/codes")
        return found

    def _coded(self, rows: DataFrame) -> DataFrame:
        """list, id and body, the code, of stored vectors."""
        centres, codes, distance, radius, dims = self.centres, self.codes, self.distance, self.radius, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = _placed(_matrix(batch.column(1), dims), distance, radius)
                own = _apart(points, centres).argmin(axis=1)
                left, at, code = points - centres[own], 0, np.zeros((len(points), len(codes)), np.uint8)
                for k, c in enumerate(codes):
                    code[:, k] = _apart(left[:, at : at + c.shape[1]], c).argmin(axis=1)
                    at += c.shape[1]
                body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(codes)), len(points), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0), body], names=["list", "id", "body"])

        return rows.select("id", "vector").mapInArrow(run, f"list int, id {rows.schema['id'].dataType.simpleString()}, body binary")

    def candidates(self, queries: DataFrame, probes: int, keep: int) -> DataFrame:
        """query_id, id and gap (squared distance by codes) of each query's best ``keep`` of its ``probes`` nearest lists."""
        centres, codes, distance, dims = self.centres, self.codes, self.distance, self.dims
        asked = _asked(queries, dims)
        blocks = self.spark.read.parquet(f"{self.path}/codes")
        kind, key = asked.schema["id"].dataType.simpleString(), blocks.schema["v_ids"].dataType.elementType.simpleString()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    points = _looked_up(_matrix(batch.column(1), dims), distance)
                    order = np.argsort(_apart(points, centres), axis=1, kind="stable")[:, :probes]
                    at = np.repeat(np.arange(batch.num_rows), order.shape[1])
                    body = [x.tobytes() for x in points]
                    yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), batch.column(0).take(pa.array(at)), pa.array([body[k] for k in at], pa.binary())], names=["list", "id", "body"])

        by_list = asked.select("id", "vector").mapInArrow(near, f"list int, id {kind}, body binary")
        pairs = blocks.join(_runs(by_list.repartition("list").sortWithinPartitions("list"), BLOCK, "q"), "list")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    row = {name: batch.column(name).slice(n, 1) for name in batch.schema.names}
                    ids, names = row["v_ids"].flatten(), row["q_ids"].flatten()
                    code = np.frombuffer(row["v_body"][0].as_py(), np.uint8).reshape(len(ids), len(codes))
                    points = np.frombuffer(row["q_body"][0].as_py(), "<f8").reshape(len(names), -1) - centres[row["list"][0].as_py()]
                    gaps, at = np.zeros((len(names), len(ids)), np.float32), 0
                    for k, c in enumerate(codes):
                        gaps += _apart(points[:, at : at + c.shape[1]], c).astype(np.float32)[:, code[:, k]]
                        at += c.shape[1]
                    most = min(keep, len(ids))
                    best = np.argpartition(gaps, most - 1, axis=1)[:, :most]
                    a, b = np.repeat(np.arange(len(names)), most), best.ravel()
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), ids.take(pa.array(b)), pa.array(gaps[a, b].astype(np.float64))], names=["query_id", "id", "gap"])

        found = pairs.select("list", "v_ids", "v_body", "q_ids", "q_body").mapInArrow(scan, f"query_id {kind}, id {key}, gap double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "id"))
        return found.withColumn("place", place).filter(F.col("place") <= keep).drop("place")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, recompute: int = 10) -> DataFrame:
        """query_id, id, score and rank, approximately: the best ``recompute`` times ``k`` by codes are scored by their vectors. Without ``probes`` two thirds of the lists are looked through, of few lists all."""
        probes = probes or max(-(-2 * len(self.centres) // 3), min(len(self.centres), 16))
        few = cut(self.candidates(queries, probes, recompute * k))
        wanted = few.select("id").distinct()
        vectors = self.spark.read.parquet(f"{self.path}/vectors").join(wanted, "id", "left_semi")
        asked = _asked(queries, self.dims).select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))
        distance, dims = self.distance, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = _pairwise(_matrix(batch.column(2), dims), _matrix(batch.column(3), dims), distance)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["query_id", "id", "score"])

        rows = few.join(vectors, "id").join(asked, "query_id").select("query_id", "id", "vector", "asked")
        kinds = f"query_id {rows.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
        return _ranked(rows.mapInArrow(run, kinds), k)


class Exact:
    """No index: every vector is scored."""

    def __init__(self, vectors: DataFrame, dims: int, distance: str):
        self.vectors, self.dims, self.distance = vectors, dims, distance

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return top_k(self.vectors, queries, k, self.distance, self.dims)


def index_of(policy: str, vectors: DataFrame, path: str, dims: int = 64, distance: str = "cosine") -> Exact | CodedLists | Graphs:
    """The index that a collection's policy asks for, built at ``path``."""
    choice = index_choice(policy)
    if choice["kind"] == "hnsw":
        return Graphs.build(vectors, path, dims, distance, choice["m"], choice["ef_construction"])
    if choice["kind"] == "ivfflat":
        return CodedLists.build(vectors, path, dims, choice["lists"], distance)
    return Exact(vectors, dims, distance)
