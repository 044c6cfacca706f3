"""Quality rules with cross-document line frequency.

Lines are normalised and hashed, and a line's distinct documents are counted per
host. Lines of more documents than the limit are removed; a document of which too
little remains is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Out, materialise, rows_of

#: Words numbered at once; a number takes 21 bits at most.
KNOWN = 1 << 18
SYMBOLS = b"#*$%&|<>"
DIGITS = bytes.maketrans(b"123456789", b"000000000")


def line_key(line: bytes) -> int:
    """Hash of the line in lower case with white space as one blank and every digit as 0; 0 for a line without words."""
    words = line.lower().translate(DIGITS).split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63 if words else 0


def repeated_words(words: list[bytes], ids: dict[bytes, int]) -> int:
    """Words that lie in a three-word window found twice or more. ids: numbers given so far, for reuse between texts."""
    if len(words) < 4:
        return 0
    if len(ids) + len(words) >= KNOWN:
        ids.clear()
    if len(words) >= 1 << 21:  # their numbers might not fit in 21 bits
        return _repeated_words_long(words)
    number = ids.setdefault
    v = np.fromiter((number(w, len(ids)) for w in words), np.int64, len(words))
    keys = v[:-2] << 42 | v[1:-1] << 21 | v[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(words), bool)
    for at in (order[1:][same], order[:-1][same]):
        hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def _repeated_words_long(words: list[bytes]) -> int:
    first: dict[tuple, int] = {}
    hit = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        j = first.setdefault(window, i)
        if j != i:
            hit[i : i + 3] = hit[j : j + 3] = b"\1\1\1"
    return sum(hit)


def features(docs: DataFrame, id_column: str, host_column: str, text_column: str, keep_text: bool) -> DataFrame:
    """One row per document: the base counts, its distinct lines' keys and the words that each of them holds."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"id {types[id_column]}, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, text_key bigint, lines array<bigint>, line_words array<bigint>, body string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        out = None
        for batch in batches:
            if out is None:
                longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key")
                out = Out(pa.schema([("id", batch.schema.field(0).type), ("host", pa.string()), *((x, pa.int64()) for x in longs), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64())), ("body", pa.string())]), 1024)
            hosts = batch.column(1).to_pylist()
            for (i, text), host in zip(rows_of(iter([batch]), "id", "body"), hosts, strict=True):
                words = text.split()
                lines = [x for x in text.split(b"\n") if x.strip()]
                chars = sum(map(len, words))
                if not text.isascii():
                    chars = sum(len(w.decode()) for w in words)
                held: dict[int, int] = {}
                for line in lines:
                    key = line_key(line)
                    held[key] = held.get(key, 0) + len(line.split())
                yield from out.add(i, host, len(words), chars, sum(text.count(s) for s in (SYMBOLS[k : k + 1] for k in range(8))), len(lines) - len(set(lines)), repeated_words(words, ids), xxhash.xxh3_64_intdigest(text) - 2**63, list(held), list(held.values()), text.decode() if keep_text else None)
        if out is not None:
            yield out.flush()

    picked = docs.select(F.col(id_column).alias("id"), F.col(host_column).cast("string").alias("host"), F.col(text_column).alias("body"))
    return picked.mapInArrow(run, schema)


def judge(docs: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text", min_docs: int = 10, max_share: float = 0.05, min_left: float = 0.3, min_words: int = 50, max_repeat: int = 50, with_text: bool = False) -> DataFrame:
    """Per row: id, the base counts, base_failed, removed_words, kept, and with ``with_text`` the text without its frequent lines.

    A line is removed if more than ``max(min_docs, max_share * documents of the
    host)`` documents of its host hold it; exact copies within a host count as
    one document. A document is rejected if it fails the base rules or if less
    than ``min_left`` of its words remain. Null and empty texts have no words and
    fail; a null host is a host of its own. Repeated rows are judged alike. Texts
    of any length are read whole, lines that tie with the limit stay, and further
    columns are ignored. An empty table gives no rows.
    """
    rows = materialise(features(docs, id_column, host_column, text_column, with_text).withColumn("uid", F.monotonically_increasing_id()), "line-features")
    known = rows.withColumn("host", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("-")))
    documents = known.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    held = known.select("host", "text_key", F.explode("lines").alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    frequent = counts.join(documents, "host").filter(F.col("n") > F.col("documents") * max_share).select("host", "line")
    lines = known.select("uid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("uid", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    lost = lines.join(frequent, ["host", "line"])
    lost = lost.groupBy("uid").agg(F.sum("words").alias("removed_words"), *([F.collect_set("line").alias("gone")] if with_text else []))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    result = rows.drop("host", "lines", "line_words").join(lost, "uid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    result = result.withColumn("base_failed", failed).withColumn("kept", ~failed & (left > 0) & (left >= min_left * F.col("n_words")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    if not with_text:
        return result.select(F.col("id").alias(id_column), *names)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body, gone in zip(batch.column("body").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                drop = set(gone or ())
                texts.append("\n".join(x for x in (body or "").split("\n") if line_key(x.encode()) not in drop) if drop else body)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n not in ("body", "gone")), pa.array(texts, pa.string())], names=[*(n for n in batch.schema.names if n not in ("body", "gone")), "body"])

    wide = result.select(F.col("id").alias(id_column), *names, "body", "gone")
    kept = wide.drop("body", "gone").schema.add("body", "string")
    return wide.mapInArrow(strip, kept).withColumnRenamed("body", text_column)
