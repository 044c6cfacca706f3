"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; a decision's node is the prefix of bits that
lead to it, and its contexts are the bytes before, from none to ``DEPTH``. Each
node and context holds a Krichevsky-Trofimov estimate; weighting mixes a
context's own estimate half and half with the product of its extensions',
recursively, and what training saw fixes the weights. Counts are gathered over
all training text as distinct byte n-grams.

Beside the model stands a word-frequency base score over the same texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Out, materialise, modest_batches, rows_of

#: Context bytes. An n-gram key holds them, the nearest in the highest bits, and in the lowest the byte to code,
#: so that keys cut to fewer context bytes stay in order.
DEPTH = 5
#: Words whose counts, and byte n-grams whose values, are shared with the executors, at most; the others' meet them in a join.
FREQUENT = 1 << 20
#: N-grams whose subtrees are held at once, unless one three-byte context has more.
GROUP = 1 << 16
#: Bytes coded at once.
CHUNK = 1 << 19

_U = np.uint64


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; x > 0."""
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def kt_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all coded bytes of the texts and where each text's keys begin. A text is followed by an end byte 0 and preceded by zeros."""
    lead = b"\0" * DEPTH
    data = np.frombuffer(b"".join([x for t in texts for x in (lead, t, b"\0")]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    keys = np.zeros(len(data) - DEPTH, _U)
    for i in range(DEPTH + 1):
        keys |= data[i : len(data) - DEPTH + i].astype(_U) << _U(8 * (i + 1) if i < DEPTH else 0)
    starts = np.cumsum(sizes) - sizes
    return keys[np.arange(sizes.sum()) + np.repeat(np.arange(len(texts)) * DEPTH, sizes)], starts


def context_mask(depth: int) -> np.uint64:
    """Bits of the ``depth`` nearest context bytes in a key."""
    return _U((1 << 8 * depth) - 1 << 8 * (DEPTH + 1 - depth))


def chunks(items: Iterator[tuple], most: int = CHUNK) -> Iterator[list[tuple]]:
    """Lists of items whose texts, the last field, hold about ``most`` bytes; a longer text is alone."""
    held, size = [], 0
    for item in items:
        if held and size + len(item[-1]) > most:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item[-1])
    if held:
        yield held


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def split_decisions(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the n-grams' decisions with their zeros and ones. A node's key is its context's bytes and then the prefix of bits behind a leading one."""
    context, byte = keys & ~_U(255), keys & _U(255)
    nodes, bits = [], []
    for i in range(8):
        nodes.append(context | _U(1 << i) | byte >> _U(8 - i))
        bits.append((byte >> _U(7 - i) & _U(1)).astype(bool))
    distinct, at = np.unique(np.concatenate(nodes), return_inverse=True)
    bit, n = np.concatenate(bits), np.tile(counts, 8)
    return distinct, np.bincount(at[~bit], n[~bit], len(distinct)), np.bincount(at[bit], n[bit], len(distinct))


def subtree(keys: np.ndarray, counts: np.ndarray, top: int) -> list[tuple[np.ndarray, ...]]:
    """Nodes of depths DEPTH to ``top``: (key, zeros, ones, weight of the node's own estimate, log of its weighted probability)."""
    found, inner = [], None
    for depth in range(DEPTH, top - 1, -1):
        keys, counts = merged(keys & (context_mask(depth) | _U(255)), counts)
        node, zeros, ones = split_decisions(keys, counts)
        found.append(weighted(node, zeros, ones, inner))
        inner = (found[-1][0] & (context_mask(depth - 1) | _U(255)), found[-1][4]) if depth else None
    return found


def weighted(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, inner: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """inner: keys, cut to this depth, and log weighted probabilities of the extensions."""
    own = log_kt(zeros, ones)
    if inner is None:
        return node, zeros, ones, np.ones(len(node)), own
    below = np.bincount(np.searchsorted(node, inner[0]), inner[1], len(node))
    return node, zeros, ones, 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.log(0.5) + np.logaddexp(own, below)


@dataclass(frozen=True)
class Tree:
    """Per depth the sorted node keys, the estimates of a one, and the weights of the own estimate."""

    keys: list[np.ndarray]
    ones: list[np.ndarray]
    weights: list[np.ndarray]

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each n-gram's last byte after its first ones."""
        total = np.zeros(len(grams))
        byte = grams & _U(255)
        for i in range(8):
            prefix = _U(1 << i) | byte >> _U(8 - i)
            one = (byte >> _U(7 - i) & _U(1)).astype(bool)
            mixed, there = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
            for depth in range(len(self.keys) - 1, -1, -1):
                if not len(self.keys[depth]):
                    continue
                key = grams & context_mask(depth) | prefix
                at = np.minimum(np.searchsorted(self.keys[depth], key), len(self.keys[depth]) - 1)
                hit = self.keys[depth][at] == key
                p, w = self.ones[depth][at], self.weights[depth][at]
                mixed = np.where(hit, np.where(there, w * p + (1 - w) * mixed, p), mixed)
                there |= hit
            total += np.log10(np.where(one, mixed, 1 - mixed))
        return total


@dataclass(frozen=True)
class Frequent:
    """Sorted n-grams and their values."""

    keys: np.ndarray
    values: np.ndarray

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """The n-grams' values, NaN for those not among the frequent ones."""
        if not len(self.keys):
            return np.full(len(grams), np.nan)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        return np.where(self.keys[at] == grams, self.values[at], np.nan)


class Coder:
    """Codes texts, remembering n-grams already met in a table of fixed size."""

    def __init__(self, tree: Tree | Frequent, bits: int = 20):
        self.tree, self.shift = tree, _U(64 - bits)
        self.keys, self.values = np.full(1 << bits, ~_U(0)), np.zeros(1 << bits)

    def log10(self, texts: list[bytes]) -> np.ndarray:
        grams, starts = gram_keys(texts)
        return np.add.reduceat(self.values_of(grams), starts)

    def known(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Per text: the sum over the n-grams that have a value, the distinct others and how often each occurs."""
        grams, starts = gram_keys(texts)
        values = self.values_of(grams)
        rare = np.flatnonzero(np.isnan(values))
        values[rare] = 0
        owner, key = np.searchsorted(starts, rare, "right") - 1, grams[rare].astype(np.int64)
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1).astype(bool) | np.diff(key, prepend=-1).astype(bool))
        times = np.diff(first, append=len(key))
        cuts = np.searchsorted(owner[first], np.arange(1, len(texts)))
        return np.add.reduceat(values, starts), np.split(key[first], cuts), np.split(times, cuts)

    def values_of(self, grams: np.ndarray) -> np.ndarray:
        slots = (grams * _U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        values = self.values[slots]
        missed = np.flatnonzero(self.keys[slots] != grams)
        if len(missed):
            new, at = np.unique(grams[missed], return_inverse=True)
            found = self.tree.log10(new)
            values[missed] = found[at]
            place = (new * _U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
            self.keys[place], self.values[place] = new, found
            # of two n-grams with one slot the last stays, in both tables
        return values


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def gather(training: DataFrame, text_column: str = "text", with_words: bool = True) -> DataFrame:
    """kind (0: word, 1: byte n-gram, 2: text), key and count over all texts; words, left out on demand, go by a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

        def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 1 << 16):
                part = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.astype(np.int64)), pa.array(counts[at : at + (1 << 16)])], schema=schema)

        words: Counter[bytes] = Counter()
        held, fresh, texts = [], 0, 0

        def word_rows() -> Iterator[pa.RecordBatch]:
            yield from rows(0, np.fromiter(map(_hash, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        for part in chunks(rows_of(batches, "body")):
            lowered = [t.lower() for (t,) in part]
            texts += len(lowered)
            for t in lowered if with_words else ():
                words.update(t.split())
            if len(words) > 1 << 16:
                yield from word_rows()
            held.append(np.unique(gram_keys(lowered)[0], return_counts=True))
            fresh += len(held[-1][0])
            if fresh > 1 << 19:
                held, fresh = [merged(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))], 0
                if len(held[0][0]) > 1 << 20:
                    yield from rows(1, *held.pop())
        yield from word_rows()
        if held:
            yield from rows(1, *merged(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])))
        yield from rows(2, np.zeros(1, np.int64), np.array([texts]))

    found = training.select(F.col(text_column).alias("body")).mapInArrow(run, "kind int, key bigint, n bigint")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def pieces(batches: Iterator[pa.RecordBatch], whole) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows in pieces of ``GROUP`` rows or more, cut where ``whole`` of them changes."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size < GROUP:
            continue
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        mark = whole(rows)
        end = int(np.searchsorted(mark, mark[-1]))
        if end:
            yield [x[:end] for x in rows]
        held, size = [[x[end:] for x in rows]], size - end
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def lifted(level: tuple[np.ndarray, ...], depth: int) -> tuple[np.ndarray, ...]:
    """Keys cut to ``depth`` context bytes, with the sums of their extensions' zeros, ones and log weighted probabilities."""
    node, at = np.unique(level[0] & (context_mask(depth) | _U(255)), return_inverse=True)
    return (node, *(np.bincount(at, x, len(node)) for x in (level[1], level[2], level[-1])))


def valued(grams: DataFrame) -> DataFrame:
    """key, met and value: log10 of the probability of each n-gram (key, n times in training, met in all texts) by the whole tree.

    N-grams are dealt by their two nearest context bytes and come sorted, so that
    a task holds the subtrees of some three-byte contexts at a time. What these
    add up to at two bytes is a table, of at most 2^16 * 255 rows; it is dealt
    alike, and a context's rows come before its n-grams. Nodes of depths 0 and 1,
    at most 257 * 255, are shared.
    """
    near = F.shiftright("key", 8 * (DEPTH - 1))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_nodes: tuple[np.ndarray, ...] | None = None

        def rows(nodes: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            node, zeros, ones, weight, inside = weighted(nodes[0], nodes[1], nodes[2], (nodes[0], nodes[3]))
            return pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), *map(pa.array, (zeros, ones, weight, inside))], names=["key", "zeros", "ones", "weight", "weighted"])

        for keys, counts in pieces(batches, lambda x: x[0] >> 8 * (DEPTH - 2)):
            seen = counts > 0
            nodes = lifted(subtree(keys[seen].astype(_U), counts[seen], 3)[-1], 2) if seen.any() else None
            if nodes is None:
                continue
            if open_nodes is not None:
                nodes = lifted(tuple(np.concatenate(x) for x in zip(open_nodes, nodes, strict=True)), 2)
            # the last context may go on in the next piece
            last = nodes[0] >> _U(8 * (DEPTH - 1)) == nodes[0][-1] >> _U(8 * (DEPTH - 1))
            done, open_nodes = tuple(x[~last] for x in nodes), tuple(x[last] for x in nodes)
            if len(done[0]):
                yield rows(done)
        if open_nodes is not None:
            yield rows(open_nodes)

    sorted_grams = grams.select("key", "n").repartition(near).sortWithinPartitions("key")
    nodes = materialise(sorted_grams.mapInArrow(below, "key bigint, zeros double, ones double, weight double, weighted double"), "lm-nodes")
    upper = nodes.groupBy(F.col("key").bitwiseAND(int(context_mask(1)) | 255).alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    first = upper.toPandas().sort_values("key")
    inner = first["key"].to_numpy().astype(_U), first["below"].to_numpy()
    one = weighted(inner[0], first["zeros"].to_numpy(), first["ones"].to_numpy(), inner)
    root, at = np.unique(inner[0] & _U(255), return_inverse=True)
    none = weighted(root, np.bincount(at, first["zeros"], len(root)), np.bincount(at, first["ones"], len(root)), (inner[0] & _U(255), one[4]))
    shared = grams.sparkSession.sparkContext.broadcast((none, one))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0)
        held = (np.zeros(0, _U), empty, empty)
        for kind, keys, counts, met, zeros, ones, weight in pieces(batches, lambda x: x[1] >> 8 * (DEPTH - 1) << 9 | x[0].astype(np.int64) << 8 | np.where(x[0] == 1, x[1] >> 8 * (DEPTH - 2) & 255, 0)):
            node = kind == 0
            # the nodes of a context that began in the piece before are still needed
            held = tuple(np.concatenate([a, b]) for a, b in zip(held, (keys[node].astype(_U), kt_one(zeros[node], ones[node]), weight[node]), strict=True))
            grams_here, n, often = keys[~node].astype(_U), counts[~node], met[~node]
            if len(grams_here):
                seen = n > 0
                levels = subtree(grams_here[seen], n[seen], 3) if seen.any() else []
                every = [*shared.value, *levels[::-1]]
                tree = [(x[0], kt_one(x[1], x[2]), x[3]) for x in every]
                tree.insert(2, held)
                whole = Tree(*(list(x) for x in zip(*tree, strict=True)))
                for at in range(0, len(grams_here), 1 << 16):
                    part = grams_here[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(often[at : at + (1 << 16)]), pa.array(whole.log10(part))], names=["key", "met", "value"])
            last = held[0] >> _U(8 * (DEPTH - 1)) == _U(int(keys[-1])) >> _U(8 * (DEPTH - 1))
            held = tuple(x[last] for x in held)

    zero = F.lit(0.0)
    both = nodes.select(F.lit(0).alias("kind"), "key", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("met"), "zeros", "ones", "weight")
    both = both.unionByName(grams.select(F.lit(1).alias("kind"), "key", "n", "met", zero.alias("zeros"), zero.alias("ones"), zero.alias("weight")))
    return both.repartition(near).sortWithinPartitions(near, "kind", "key").mapInArrow(run, "key bigint, met bigint, value double")


def most_frequent(counted: DataFrame, by: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of the most frequent words or n-grams: all above a count that leaves ``FREQUENT`` of them at most."""
    step = F.floor(8 * F.log2(F.col(by).cast("double"))).cast("int")
    histogram = sorted(((r[0], r[1]) for r in counted.groupBy(step.alias("step")).count().collect()), reverse=True)
    held, least = 0, None
    for at, n in histogram:
        held += n
        if held > FREQUENT:
            break
        least = at
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counted.filter(step >= least).select("key", value).toArrow()
    keys, values = found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    The model and the counts come from the rows that are not held out; without
    any, every decision costs one bit and no word is known. A null text is empty:
    its one token and its one coded byte are the end. Repeated rows count and are
    scored each, whole texts at any length; words and n-grams that tie in number
    are held or joined as their keys go, to the same score; columns besides the
    two named are ignored; an empty table gives no rows.
    """
    modest_batches(docs.sparkSession)
    picked = docs.select(F.col(id_column).alias("id"), held_out.alias("held_out"), F.col(text_column).alias("body"))
    counts = materialise(gather(picked.filter(~F.col("held_out")), "body"), "lm-counts")
    words = counts.filter("kind = 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    texts = counts.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, kinds = total + texts, distinct + (texts > 0)
    met = gather(picked.filter("held_out"), "body", with_words=False).filter("kind = 1").select("key", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("met"))
    grams = counts.filter("kind = 1").select("key", "n", F.col("n").alias("met")).unionByName(met).groupBy("key").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))
    values = materialise(valued(materialise(grams, "lm-grams")), "lm-values")
    shared = docs.sparkSession.sparkContext.broadcast((most_frequent(values, "met", "value"), *most_frequent(words, "n", "n")))
    floor = float(tokens + 0.1 * (kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (grams, logs), frequent, times = shared.value
        coder = Coder(Frequent(grams.astype(_U), logs))
        known = _Known(frequent, times)
        longs, lists = pa.int64(), pa.list_(pa.int64())
        kind = None
        for batch in batches:
            kind = kind or batch.schema.field("id").type
            out = Out(pa.schema([("id", kind), ("held_out", pa.bool_()), ("n_tokens", longs), ("known_", longs), ("base_", pa.float64()), ("score", pa.float64()), ("bytes", longs), ("rare", lists), ("rare_n", lists), ("grams", lists), ("grams_n", lists)]), 1 << 30)
            for part in chunks(rows_of(iter([batch]), "id", "held_out", "body")):
                lowered = [t.lower() for *_, t in part]
                sums, others, often = coder.known(lowered)
                for (i, held, _), text, value, other, many in zip(part, lowered, sums.tolist(), others, often, strict=True):
                    at, rare = known.of(text.split())
                    found = at[at >= 0]
                    base = np.log10((known.times[found] + 0.1) / floor).sum() + np.log10((texts + 0.1) / floor)
                    for _ in out.add(i, held, len(at) + 1, len(found) + (texts > 0), float(base), value, len(text), list(rare), list(rare.values()), other, many):
                        pass
            yield out.flush()

    kind = docs.schema[id_column].dataType.simpleString()
    scored = picked.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, known_ bigint, base_ double, score double, bytes bigint, rare array<bigint>, rare_n array<bigint>, grams array<bigint>, grams_n array<bigint>")
    scored = materialise(scored.withColumn("uid", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("uid", F.col("x.rare").alias("key"), F.col("x.rare_n").alias("times"))
    found = rare.join(words, "key", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(floor))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    others = scored.select("uid", F.explode(F.arrays_zip("grams", "grams_n")).alias("x")).select("uid", F.col("x.grams").alias("key"), F.col("x.grams_n").alias("times"))
    coded = others.join(values, "key").groupBy("uid").agg(F.sum(F.col("times") * F.col("value")).alias("rest"))
    result = scored.drop("rare", "rare_n", "grams", "grams_n").join(found, "uid", "left").join(coded, "uid", "left")
    result = result.withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    bits = -F.col("score") * float(np.log2(10)) / (F.col("bytes") + 1)
    return result.select(F.col("id").alias(id_column), "held_out", "n_tokens", (F.col("known_") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("bigint").alias("train_tokens"), (F.col("base_") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", bits.alias("bits_per_byte"))


class _Known:
    """Places of words in the table of frequent ones, each word looked up once."""

    def __init__(self, keys: np.ndarray, times: np.ndarray, most: int = 1 << 17):
        self.keys, self.times, self.most = keys, times, most
        self.place: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> tuple[np.ndarray, dict[int, int]]:
        """Each word's place or -1, and how often each of those with -1 occurs, by its hash."""
        place = self.place
        new = list(set(words).difference(place))
        if new:
            if len(place) + len(new) > self.most:
                place.clear()
                new = list(set(words))
            hashes = np.fromiter(map(_hash, new), np.int64, len(new))
            at = np.searchsorted(self.keys, hashes)
            hit = np.zeros(len(new), bool)
            inside = at < len(self.keys)
            hit[inside] = self.keys[at[inside]] == hashes[inside]
            place.update(zip(new, np.where(hit, at, -1).tolist(), strict=True))
        found = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        rare: dict[int, int] = {}
        for k in np.flatnonzero(found < 0).tolist():
            h = _hash(words[k])
            rare[h] = rare.get(h, 0) + 1
        return found, rare
