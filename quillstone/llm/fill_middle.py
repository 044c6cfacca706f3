"""Fill-in-the-middle transformation by a sparse checkpoint index over each text.

While a text's units are counted, the byte and the code point at which every
``STEP``-th unit starts are written down. A cut is found by binary search over
these checkpoints and a short scan from the one before it, so that no array is as
long as the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import rows_of

#: Units between checkpoints, and bytes looked at together while they are counted.
STEP, BLOCK = 1024, 1 << 16
#: Bytes of texts in a batch of results, about.
FULL = 1 << 22
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _leads(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


def _line_starts(data: np.ndarray, before: int) -> np.ndarray:
    return np.concatenate([[before], data[:-1]]) == 10


def _word_starts(data: np.ndarray, before: int) -> np.ndarray:
    both = np.concatenate([[before], data])
    blank = (both == 32) | (both >= 9) & (both <= 13)
    return blank[:-1] & ~blank[1:]


#: Which bytes begin a unit, from a block and the byte before it. Words carry the white space behind them; what stands before the first belongs to it.
UNITS = {"code_point": lambda data, before: _leads(data), "line": _line_starts, "word": _word_starts}


class Checkpoints:
    """Unit, byte and code point of every ``step``-th unit of UTF-8 bytes, with the number of units and code points."""

    def __init__(self, text: bytes, unit: str = "code_point", step: int = STEP):
        self.data, self.starts, self.step = np.frombuffer(text, np.uint8), UNITS[unit], step
        self.units = self.points = 0
        marks = []
        for at, starts, leads in self._blocks(0, BLOCK):
            here = np.flatnonzero(starts)
            first = -self.units % step
            picked = here[first::step]
            if len(picked):
                marks.append(np.stack([self.units + first + step * np.arange(len(picked)), at + picked, self.points + np.cumsum(leads)[picked] - leads[picked]]))
            self.units += len(here)
            self.points += int(leads.sum())
        self.marks = np.concatenate(marks, axis=1) if marks else np.zeros((3, 0), np.int64)

    def _blocks(self, at: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Offset, unit starts and code point starts of each block from a byte on."""
        for begin in range(at, len(self.data), size):
            block = self.data[begin : begin + size]
            starts = self.starts(block, self.data[begin - 1] if begin else 0)
            if not begin:
                starts[0] = True
                if self.starts is _word_starts:  # blanks before the first word begin it
                    rest = np.flatnonzero(starts[1:])
                    if block[0] in b" \t\n\v\f\r" and len(rest):
                        starts[1 + rest[0]] = False
            yield begin, starts, _leads(block)

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code point at which a unit begins, the ends for the number of units."""
        if unit >= self.units:
            return len(self.data), self.points
        number, at, point = (int(x) for x in self.marks[:, np.searchsorted(self.marks[0], unit, "right") - 1])
        for begin, starts, leads in self._blocks(at, 4 * self.step):
            here = np.flatnonzero(starts)
            if unit - number < len(here):
                found = int(here[unit - number])
                return begin + found, point + int(leads[:found].sum())
            number += len(here)
            point += int(leads.sum())
        raise ValueError("a checkpoint lies behind its unit")


def draws(key: object, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits from the seed and a row's id; a null id is empty."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be told from what stands around them: none holds another, none begins as one ends."""
    for a in marks:
        for b in marks:
            if not a or a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"marks that cannot be told apart: {marks}")
    return marks


def apply(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = "code_point", seed: int = 1, percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Per row: id, n (its units), form, prefix_chars and middle_chars (code points, null if plain) and output.

    Two cuts from the id's hash divide a text of ``unit`` (code_point, line or
    word) into prefix, middle and suffix. ``percent`` of the texts are transformed
    and ``spm_percent`` of these have the suffix first; empty and null texts and
    those that hold a mark stay plain. Texts of any length are indexed whole.
    Rows of equal id and text get equal results, as rows of null ids do among each
    other; an empty table gives no rows; columns besides the two named are
    ignored.
    """
    p, s, m = (x.encode() for x in _checked(marks))
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

    def one(key: object, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        index = Checkpoints(text, unit)
        h1, h2, h3, h4 = draws(key, seed)
        if not text or h3 % 100 >= percent or p in text or s in text or m in text:
            return index.units, PLAIN, None, None, text
        low, high = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
        (a, a_point), (b, b_point) = index.cut(low), index.cut(high)
        if h4 % 100 < spm_percent:
            form, output = SPM, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
        else:
            form, output = PSM, b"".join((p, text[:a], s, text[b:], m, text[a:b]))
        return index.units, form, a_point, b_point - a_point, output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            rows, size = [], 0

            def flush(kinds=kinds, rows=rows) -> pa.RecordBatch:
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                rows.clear()
                return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].view(pa.string())], names=[id_column, "n", "form", "prefix_chars", "middle_chars", "output"])

            for key, text in rows_of(iter([batch]), "key", "body"):
                rows.append((key, *one(key, text)))
                size += len(text)
                if size >= FULL:
                    yield flush()
                    size = 0
            if rows:
                yield flush()

    return docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("body")).mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of which an output was made, from the output and its form alone."""
    parts = F.split(output, "|".join(re.escape(x) for x in _checked(marks)), -1)
    part = lambda *order: F.concat(*(F.get(parts, k) for k in order))
    return F.when(form == PSM, part(1, 3, 2)).when(form == SPM, part(2, 3, 1)).otherwise(output)
