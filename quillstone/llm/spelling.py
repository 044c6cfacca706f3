"""Grouping of spelling variants with forward and reversed sorted dictionaries.

Two words one edit apart share all that stands before the edit and all behind it.
An edit in the second half leaves the first half whole, so such words lie
together in the dictionary sorted from the front; an edit in the first half leaves
the second, and they lie together in the one sorted from the back. Blocks of words
with the same half are scanned as ranges of these dictionaries. A block of too
many words is divided: the half that holds the edit is halved again, and words
must then share a quarter more, until a single place is left, where a block has
at most as many words as the alphabet has letters.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, rows_of

#: What a word is made of; a run of it is maximal.
LETTERS = "a-zÀ-ÿ"
#: Distinct words whose counts a task holds before it hands them on.
HELD = 1 << 18
#: Words of a block beyond which it is divided.
BLOCK = 64
#: Pairs that are compared at once, by so many letters at a time.
PAIRS, WIDTH = 1 << 17, 8
#: One run in so many loses a letter.
EVERY = 199


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = 6, drop_every: int | None = EVERY) -> DataFrame:
    """word and n: how often each run of letters of at least ``min_length`` code points occurs, A-Z as a-z.

    With ``drop_every`` the run of a document whose crc32 of ``<id>:<run>`` it
    divides loses the letter at that number modulo its length. Tasks sum up their
    words before they are shuffled.
    """
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for key, body in rows_of(batches, "key", "body"):
            own = Counter(runs.findall(body.lower().decode()))
            if drop_every is None:
                held.update(own)
            else:
                begin = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % drop_every == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += n
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    found = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("body")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


#: Both halves of the places at which a word of ``{0}`` letters is edited; an insertion may stand behind the last.
_HALVES = "named_struct('base', {0}, 'low', 0, 'high', {0} div 2, 'kind', 0), named_struct('base', {0}, 'low', {0} div 2, 'high', {0} + 1, 'kind', 0)"
#: The halves of a divided span; a single place divided into replacements (kind 2) and insertions (kind 1).
_DIVIDED = """
CASE WHEN high - low > 1 THEN array(named_struct('base', base, 'low', low, 'high', (low + high) div 2, 'kind', 0), named_struct('base', base, 'low', (low + high) div 2, 'high', high, 'kind', 0))
WHEN length = base THEN array(named_struct('base', base, 'low', low, 'high', high, 'kind', 2), named_struct('base', base, 'low', low, 'high', high, 'kind', 1))
ELSE array(named_struct('base', base, 'low', low, 'high', high, 'kind', 1)) END"""
_SPAN = "array<struct<base:int,low:int,high:int,kind:int>>"


def _entries(words: DataFrame, spans: str) -> DataFrame:
    """A row for each word and span (base, low, high, kind), with the block that it is in.

    A block holds words of ``base`` and of one letter more that are edited at a
    place from ``low`` to before ``high``: they share ``low`` letters in front
    (head) and all of base behind ``high`` (tail, written backwards). For an
    insertion at a single place (kind 1) the longer words leave its letter out and
    share all the rest.
    """
    rows = words.select("word", "n", "length", F.explode(F.expr(spans).cast(_SPAN)).alias("s")).select("word", "n", "length", "s.*")
    rest = F.expr("CASE WHEN length > base THEN concat(substring(word, 1, low), substring(word, low + 2, length)) ELSE word END")
    rows = rows.withColumns({"head": F.when(F.col("kind") == 1, rest).otherwise(F.expr("substring(word, 1, low)")), "tail": F.when(F.col("kind") == 1, "").otherwise(F.expr("substring(reverse(word), 1, greatest(base - high, 0))"))})
    return rows.withColumn("block", F.xxhash64("base", "low", "high", "kind", "head", "tail"))


def blocks(words: DataFrame, most: int = BLOCK) -> list[DataFrame]:
    """Entries of ``words`` (word, n, length) in blocks of two words at least, and of ``most`` at most unless a single place has more."""
    found, rest = [], _entries(words, f"array({_HALVES.format('length')}, {_HALVES.format('(length - 1)')})")
    while True:
        rest = materialise(rest, "spelling-entries")
        sizes = materialise(rest.groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "spelling-sizes")
        large = sizes.filter(F.col("size") > most)
        small = rest.join(sizes, "block").filter((F.col("size") <= most) | (F.col("kind") > 0)).drop("size")
        found.append(small)
        divided = rest.filter("kind = 0").join(large.drop("size"), "block", "left_semi")
        if divided.isEmpty():
            return found
        rest = _entries(divided, _DIVIDED)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that end with a block's end, with where blocks begin in them and the end."""
    held = None
    for batch in batches:
        if batch.num_rows:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = rows.column("block").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            if cuts[-1]:
                yield rows.slice(0, cuts[-1]), cuts  # the last cut is their end
            held = rows.slice(cuts[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _pairs_of(cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within blocks, a bounded number at a time. cuts: where blocks begin, and the end."""
    later = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(cuts[-1]) - 1  # rows behind each one in its block
    ends, at = np.cumsum(later), 0
    while at < len(later):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = later[at:stop]
        first = np.repeat(np.arange(at, stop), n)
        yield first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def _shared(letters: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many letters from x and y on, forwards or backwards (step), are equal in a row, ``most`` at most."""
    found, left, k = np.zeros(len(x), np.int64), np.flatnonzero(most > 0), 0
    while len(left):
        place = np.arange(k, k + WIDTH)
        inside = place < most[left, None]
        where = np.where(inside, step * place, 0)
        same = (letters[x[left, None] + where] == letters[y[left, None] + where]) & inside
        run = np.where(same.all(axis=1), WIDTH, same.argmin(axis=1))
        found[left] += run
        left, k = left[run == WIDTH], k + WIDTH
    return found


def _near(rows: pa.RecordBatch, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in blocks that are one edit apart at a place of their block's."""
    words = rows.column("word").to_pylist()
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    base, low, high, size = (rows.column(c).to_numpy() for c in ("base", "low", "high", "length"))
    begin = np.cumsum(size) - size
    for a, b in _pairs_of(cuts):
        longer = size[a] > size[b]
        x, y = np.where(longer, b, a), np.where(longer, a, b)
        own = size[x] == base[x]  # two of the longer words meet where their length is the base
        x, y = x[own], y[own]
        front = _shared(letters, begin[x], begin[y], size[x].astype(np.int64), 1)
        here = (front >= low[x]) & (front < high[x])
        x, y, front = x[here], y[here], front[here]
        back = _shared(letters, begin[x] + size[x] - 1, begin[y] + size[y] - 1, size[y] - 1 - front, -1)
        near = front + back == size[y] - 1
        yield x[near], y[near]


def near_pairs(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, n, other and other_n of all words (word, n, length; each once) that differ by one inserted, deleted or replaced code point, each pair both ways.

    A pair comes from the one block that has the place behind its common
    beginning.
    """
    entries = functools.reduce(DataFrame.unionByName, blocks(words, most))
    # the forward dictionary and the reversed one: equal heads lie together in the first, equal tails in the second
    order = ["head", "tail", "block"]
    dictionary = entries.repartitionByRange(*order).sortWithinPartitions(*order, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _whole_runs(batches):
            for x, y in _near(rows, cuts):
                a, b = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
                word, n = rows.column("word"), rows.column("n")
                yield pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], names=["word", "n", "other", "other_n"])

    return dictionary.select("block", "word", "n", "length", "base", "low", "high").mapInArrow(run, "word string, n bigint, other string, other_n bigint")


def _followed(forms: DataFrame) -> DataFrame:
    """word and root of ``forms`` (word, form), which have no cycles: every round follows what was followed so far."""
    reached = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = reached.join(further, "root", "left")
        if joined.filter("next IS NOT NULL").isEmpty():
            return reached
        reached = materialise(joined.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5, drop_every: int | None = EVERY, most: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``min_length`` letters and ``min_count`` occurrences.

    form is the near word of largest n, the smallest of ties, if it occurs
    ``ratio`` times as often; root is the last form of forms. Null and empty texts
    have no words; texts are read whole, and words of any length compared whole;
    repeated rows count each; a null id is an empty one; further columns are
    ignored. An empty table gives no rows.
    """
    counts = word_counts(docs, id_column, text_column, min_length, drop_every).filter(F.col("n") >= min_count)
    words = materialise(counts.select("word", "n", F.length("word").alias("length")), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_pairs(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    near = near.withColumn("frequent", -F.col("best.less") >= ratio * F.col("n"))
    near = materialise(near.select("word", "n_near", F.when(F.col("frequent"), F.col("best.other")).alias("form"), F.when(F.col("frequent"), -F.col("best.less")).alias("form_n")), "spelling-near")
    roots = _followed(near.filter("form IS NOT NULL"))
    found = words.join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
