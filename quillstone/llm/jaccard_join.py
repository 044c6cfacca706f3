"""Exact n-gram Jaccard join by partitions of the token universe.

A document is the set of its hashed word shingles. For each band of sizes the
universe is split by hash into segments; two sets that differ in H tokens at most
must agree on one of H + 1 segments, or, where a segment counts for two, differ
in one token there at most, which the neighbourhood of one deletion shows. A cost
model allots one or two to the segments of each band and adds spare ones. Of any
order that two sets see alike, each may leave out as many signatures at the same
end as it has more than needed, and the two still share another: a set first
leaves out its emptiest segments, as far as it is smaller than its band's largest,
and later its most frequent signatures, as many as are spare. Candidates are
verified exactly.

Equal sets are one class. Within a signature's group each class is first checked
against one leader. Classes that share a leader and are still in different
components are compared by sketches, in blocks of bounded size, and what the
sketches leave is checked in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.common import Out, in_blocks, materialise, modest_batches, release, rows_of, runs_of
from quillstone.llm.components import components

_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
#: Low bits of a signature: its band, and whether it may be left out when frequent.
BAND_BITS = 6


@dataclass(frozen=True)
class Scheme:
    """Segments of a band: ``double`` ones that count for two, ``single`` ones, and how many single ones are spare."""

    double: int
    single: int
    spare: int


def edges() -> list[int]:
    """Smallest sizes of the bands."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(found[-1] * 2)
    return found


EDGES = np.array(edges())


def _excess(mean: float, spare: int) -> float:
    """Expected excess of a Poisson number over ``spare``."""
    spread = 10 * math.sqrt(mean) + 20
    if abs(spare - mean) > spread or mean > 500:
        return max(mean - spare, 0.0)
    p, below = math.exp(-mean), 0.0
    for k in range(spare + 1):
        below += (spare - k) * p
        p *= mean / (k + 1)
    return max(mean - spare + below, 0.0)


@lru_cache
def scheme(band: int, num: int, den: int, common: float = 0.35, weight: float = 60.0) -> Scheme | None:
    """The cheapest split of a band, or None if only equal sets are as similar there.

    The cost, for the band's largest sets, is the number of signatures and, with a weight, the expected number
    of signatures without a rare token that are not left out; ``common`` is the
    share of tokens taken to be frequent.
    """
    differ = most_differ(int(EDGES[band + 1]) - 1, num, den)
    if differ == 0:
        return None
    size = int(EDGES[band + 1]) - 1
    best = (math.inf, None)
    for spare in range(65):
        need = differ + 1 + spare
        for double in sorted({0, *np.linspace(0, need // 2, 24).astype(int).tolist()}):
            single = need - 2 * double
            if single < spare:
                continue
            per = size / (double + single)
            rare = per * (1 - common)
            cost = single + double * (1 + per) + weight * (double * math.exp(-rare) * (1 + rare) + _excess(single * math.exp(-rare), spare))
            if cost < best[0]:
                best = (cost, Scheme(double, single, spare))
    return best[1]


def most_differ(size: int, num: int, den: int) -> int:
    """Tokens in which a set of this size and a similar one of the same size or more differ at most."""
    return size * (den - num) // num


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(29)) * _MIX
    return x ^ x >> _U(32)


class Shingles:
    """Sorted distinct hashes of a text's shingles; words' hashes are remembered up to ``most``."""

    def __init__(self, words: int, most: int = 1 << 17):
        self.width, self.most, self.hashes = words, most, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, _U)
        hashes = self.hashes
        new = set(words).difference(hashes)
        if new:
            if len(hashes) + len(new) > self.most:
                hashes.clear()
                new = set(words)
            for w in new:
                hashes[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
        width = min(self.width, len(h))
        key = np.full(len(h) - width + 1, _U(width))
        for i in range(width):
            key = key * _MIX + h[i : len(h) - width + 1 + i]
        return np.unique(mixed(key))


def signatures(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set in its own band and, if smaller partners may lie there, in the band below."""
    size = len(tokens)
    own = int(np.searchsorted(EDGES, size, "right")) - 1
    found = []
    for band in (own, own - 1):
        if band < 0 or band < own and (int(EDGES[own]) - 1) * den < num * size:
            continue
        split = scheme(band, num, den)
        if split is None:
            continue
        segments = split.double + split.single
        at = (tokens >> _U(33)).astype(np.int64) % segments
        sums = np.zeros(segments, _U)
        np.add.at(sums, at, tokens)
        salt = (np.arange(segments, dtype=_U) * _U(2 * (1 << BAND_BITS)) + _U(band * 2 + 1)) * _MIX
        keep, tail = ~_U(2 * (1 << BAND_BITS) - 1), _U(2 * band)
        single = mixed(sums[split.double :] + salt[split.double :]) & keep | tail | _U(1)
        largest = int(EDGES[band + 1]) - 1
        surplus = most_differ(largest, num, den) - most_differ(min(size, largest), num, den)
        emptiest = np.lexsort((single, np.bincount(at, minlength=segments)[split.double :]))
        found.append(single[emptiest[min(surplus, split.single - split.spare) :]])
        if split.double:
            inner = at < split.double
            place = at[inner]
            found += [mixed(sums[: split.double] + salt[: split.double]) & keep | tail, mixed(sums[place] - tokens[inner] + salt[place]) & keep | tail]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, _U)


#: Buckets of a sketch, as a power of two: at least, and at most.
SKETCH_BITS = 6, 12


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each bucket of the universe, 255 at most; about sixteen a bucket in large sets."""
    low, high = SKETCH_BITS
    bits = min(max(low, (len(tokens) // 16).bit_length()), high)
    return np.minimum(np.bincount((tokens >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def differ_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of the number of tokens in one of two sets alone, from their sketches."""
    a, b = (np.frombuffer(z, np.uint8).astype(np.int64) for z in (x, y))
    buckets = min(len(a), len(b))
    a, b = (np.where((part := z.reshape(buckets, -1)).max(axis=1) == 255, -1, part.sum(axis=1)) for z in (a, b))
    return int(np.abs(a - b)[(a >= 0) & (b >= 0)].sum())


#: Rows of a block in which sketches are compared.
BLOCK = 512


def _folded(sketches: list[bytes], buckets: int) -> np.ndarray:
    """Sketches cut to so many buckets; a bucket that may hold more than known is -1."""
    found = np.empty((len(sketches), buckets), np.int16)
    for k, x in enumerate(sketches):
        part = np.frombuffer(x, np.uint8).reshape(buckets, -1)
        found[k] = np.where(part.max(axis=1) == 255, -1, part.sum(axis=1, dtype=np.int16))
    return found


def _meet(rows: pa.RecordBatch, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs in different components that sizes and sketches leave possible."""
    low, high, block, key, n, component = (rows.column(c).to_numpy() for c in ("low", "high", "block", "key", "n", "component"))
    if (component == component[0]).all():
        return key[:0], key[:0]
    sketches = rows.column("sketch").to_pylist()
    sizes = np.array([len(x) for x in sketches])
    found_a, found_b = [], []
    for x in np.unique(sizes):
        own = np.flatnonzero(sizes == x)
        others = np.flatnonzero(sizes >= x)
        a, b = (_folded([sketches[k] for k in at], int(x)) for at in (own, others))
        for k, i in enumerate(own):
            differ = np.abs(b - a[k])
            differ[(b < 0) | (a[k] < 0)] = 0
            good = (differ.sum(axis=1) * (den + num) <= (n[others] + n[i]) * (den - num)) & (component[others] != component[i])
            good &= (n[others] * den >= n[i] * num) & (n[i] * den >= n[others] * num)
            good &= (sizes[others] > x) | (others > i)
            if low[0] != high[0]:
                good &= block[others] != block[i]
            j = others[good]
            found_a.append(np.minimum(key[i], key[j]))
            found_b.append(np.maximum(key[i], key[j]))
    return np.concatenate(found_a), np.concatenate(found_b)


def _left_over(members: DataFrame, num: int, den: int) -> DataFrame:
    """Possible pairs (a, b) among the rows (lead, key, n, component, sketch) of each leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches):
            a, b = _meet(rows, num, den)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    columns = ["meeting", "low", "high", "block", "key", "n", "component", "sketch"]
    met = in_blocks(members, "lead", "key", BLOCK).select(*columns).repartition("meeting").sortWithinPartitions("meeting")
    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """id, n, key, text_key, and signatures once for each key and partition."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, met = Shingles(words), set()
        for batch in batches:
            out = Out(pa.schema([("id", batch.schema.field("id").type), ("n", pa.int64()), ("key", pa.int64()), ("text_key", pa.int64()), ("sigs", pa.list_(pa.int64())), ("sketch", pa.binary())]), 2048)
            for i, text_key, text in rows_of(iter([batch]), "id", "text_key", "body"):
                tokens = shingles(text)
                key = xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63 if len(tokens) else None
                sigs = drawn = None
                if len(tokens) and key not in met:
                    met.add(key)
                    sigs, drawn = _signed(signatures(tokens, num, den)), sketch(tokens)
                yield from out.add(i, len(tokens), key, text_key, sigs, drawn)
            yield out.flush()

    return docs.mapInArrow(run, f"id {kind}, n bigint, key bigint, text_key bigint, sigs array<bigint>, sketch binary")


def _shared(sigs: DataFrame) -> DataFrame:
    """Distinct (sig, key) of those signatures that several keys have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pending = None, False  # the row before, and whether it waits to be known as shared
        for batch in batches:
            sig, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                sig, key = np.append(last[0], sig), np.append(last[1], key)
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
            if last is not None and not pending:
                new[0] = False
            kept_sig, kept_key = sig[new], key[new]
            same = kept_sig[1:] == kept_sig[:-1]
            shared = np.zeros(len(kept_sig), bool)
            shared[1:] |= same
            shared[:-1] |= same
            if last is not None and not pending and len(kept_sig):
                # the row before was given already: those of its signature are shared
                shared |= kept_sig == last[0]
            end_sig, end_key = sig[-1], key[-1]
            waits = bool(len(kept_sig)) and kept_sig[-1] == end_sig and kept_key[-1] == end_key and not shared[-1]
            pending = waits
            last = (end_sig, end_key)
            out = shared.copy()
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(kept_sig[out]), pa.array(kept_key[out])], names=["sig", "key"])

    return sigs.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(run, "sig bigint, key bigint")


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sketches do not rule out that they are as similar. No such pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, x, y = (batch.column(c).to_pylist() for c in range(6))
            good = [k for k in range(batch.num_rows) if differ_at_least(x[k], y[k]) * (den + num) <= (n_a[k] + n_b[k]) * (den - num)]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], names=["a", "b"])

    first = sketches.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
    second = sketches.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are as similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held = Shingles(words), {}

        def tokens(key: int, text) -> np.ndarray:
            if key not in held:
                if len(held) >= 32:
                    held.clear()
                held[key] = shingles(text.as_py())
            return held[key]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for k in range(batch.num_rows):
                x, y = tokens(a[k], batch.column(2)[k]), tokens(b[k], batch.column(3)[k])
                both = len(x) + len(y) - len(np.union1d(x, y))
                if den * both >= num * (len(x) + len(y) - both):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], names=["a", "b"])

    first = texts.select(F.col("key").alias("a"), F.col("body").alias("body_a"))
    second = texts.select(F.col("key").alias("b"), F.col("body").alias("body_b"))
    wide = pairs.join(first, "a").join(second, "b").select("a", "b", "body_a", "body_b")
    return wide.mapInArrow(run, "a bigint, b bigint")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and body, once for each of the wanted classes."""
    wanted = wanted.withColumnsRenamed({"id": "id_", "text_key": "text_key_"})
    texts = rows.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("text_key_"))).select("key", F.col("body").cast("binary").alias("body"))
    return texts.dropDuplicates(["key"])


def _spare(sig: Column, num: int, den: int) -> Column:
    """How many single signatures may be left out in the band of ``sig``."""
    spare = [s.spare if (s := scheme(b, num, den)) else 0 for b in range(len(EDGES) - 1)]
    return F.element_at(F.array(*map(F.lit, spare)), F.shiftright(sig, 1).bitwiseAND((1 << BAND_BITS) - 1).cast("int") + 1)


def join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: id, n_shingles, text_key, component_id (smallest id reachable by links, its own included), kept (whether the row stands for its component).

    Two documents link if ``den * |intersection| >= num * |union|`` of their sets
    of distinct ``words``-word shingles; a shorter text is one shingle. Null texts
    and texts without words have empty sets, link with nothing and are their own
    components. Repeated rows link with each other, and so do rows with a null id,
    which counts as larger than any other. Sets and classes go by 64-bit hashes.
    Texts of any length are compared whole; documents just at the threshold link;
    columns besides the two named are ignored, and an empty table gives no rows.
    """
    modest_batches(docs.sparkSession)
    body = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("text_key"), body.alias("body"))
    signed = materialise(_sets(rows, words, num, den), "join-signed")
    sets = materialise(signed.drop("sigs"), "join-sets")
    classes = sets.filter("n > 0").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("first"), F.first("n").alias("n"))

    shared = materialise(_shared(signed.filter(F.col("sigs").isNotNull()).select(F.explode("sigs").alias("sig"), "key")), "join-shared")
    release(signed)
    often = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    ranked = shared.join(often, "sig").withColumns({"band": F.shiftright("sig", 1).bitwiseAND((1 << BAND_BITS) - 1), "single": F.col("sig").bitwiseAND(1)})
    order = Window.partitionBy("key", "band", "single").orderBy(F.col("often").desc(), "sig")
    kept = ranked.withColumn("rank", F.row_number().over(order)).filter((F.col("single") == 0) | (F.col("rank") > _spare(F.col("sig"), num, den)))
    # the class whose signatures most others have is near the middle of its group, and leads
    middle = ranked.groupBy("key").agg(F.sum("often").alias("weight"))
    kept = materialise(kept.select("sig", "key").join(classes.select("key", "n"), "key").join(middle, "key"), "join-kept")

    release(shared)
    similar_size = lambda a, b: (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)
    leaders = kept.groupBy("sig").agg(F.max(F.struct("weight", "key", "n")).alias("lead")).select("sig", F.col("lead.key").alias("lead"), F.col("lead.n").alias("n_lead"))
    members = materialise(kept.join(leaders, "sig").select("lead", "n_lead", "key", "n").distinct(), "join-members")
    stars = members.filter((F.col("lead") != F.col("key")) & similar_size("n_lead", "n")).select(F.col("lead").alias("a"), F.col("key").alias("b"))
    sketches = sets.filter(F.col("sketch").isNotNull()).select("key", "n", "sketch").join(kept.select("key").distinct(), "key", "left_semi")
    sketches = materialise(sketches.dropDuplicates(["key"]), "join-sketches")
    likely = materialise(_possible(stars, sketches, num, den), "join-likely")

    # texts move once, for classes that share a signature with others
    wanted = sketches.select("key").join(classes, "key").select("key", F.col("first.id").alias("id"), F.col("first.text_key").alias("text_key"))
    texts = materialise(_texts(rows, wanted), "join-texts")
    release(kept)
    links = materialise(_verified(likely, texts, words, num, den), "join-links")
    found = materialise(components(links), "join-components")

    # what the leaders have not joined is compared in different components
    placed = members.select("lead", "key", "n").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    split = placed.groupBy("lead").agg(F.min("component").alias("first"), F.max("component").alias("last")).filter("first <> last").select("lead")
    placed = placed.join(split, "lead").join(sketches.select("key", "sketch"), "key")
    likely = materialise(_left_over(placed, num, den), "join-likely")
    more = _verified(likely, texts, words, num, den)
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = classes.select("key", "first").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = materialise(named, "join-named")
    release(texts, members, sketches)
    leads = named.groupBy("component").agg(F.min("first").alias("lead"))
    named = named.join(leads, "component").select("key", "lead")
    result = sets.select("id", "n", "key", "text_key").join(named, "key", "left")
    leads_own = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("text_key") == F.col("lead.text_key"))
    return result.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "text_key", F.coalesce("lead.id", "id").alias("component_id"), (F.col("lead").isNull() | leads_own).alias("kept"))


def distinct_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their components, one of repeated rows; those with empty sets stay."""
    kept = join(docs, id_column, text_column, **options).filter("kept").select(F.xxhash64(id_column, "text_key").alias("row_key")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(F.col(id_column), F.xxhash64(F.col(text_column).cast("string"))).alias("row_key"))
    found = keyed.join(kept.hint("merge"), "row_key", "left_semi")
    same = Window.partitionBy("row_key").orderBy("row_key")
    return found.withColumn("row", F.row_number().over(same)).filter("row = 1").select("doc.*")
