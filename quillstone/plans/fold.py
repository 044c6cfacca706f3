"""Sequential state machines over keyed operations.

Some operators are defined by taking a key's operations one after another, the
next one's answer depending on what became of the last. Their rows are dealt by
key, sorted, and streamed through a step function, so that a task holds one
key's state and a batch of rows, never a key's history.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict]], answers: str, read: Callable[[pa.RecordBatch], Iterable[dict]] = pa.RecordBatch.to_pylist) -> DataFrame:
    """``rows`` with the columns of ``answers``, a schema in DDL, that ``step`` gives for each.

    ``step`` takes the key's state and a row and returns the new state and the
    answer; ``start`` makes the state that a key begins with. Rows with equal
    ``order`` follow in any order, so it should be total within a key. ``read``
    makes a batch's rows for ``step``, where not all that they hold is needed.
    """
    added = StructType.fromDDL(answers)
    kept = rows.columns
    fields = [(f.name, to_arrow_type(f.dataType)) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            found: list[dict] = []
            for key, row in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), read(batch), strict=True):
                if last is None or key != last:
                    last, state = key, start()
                state, answer = step(state, row)
                found.append(answer)
            columns = [pa.array([a.get(name) for a in found], kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *(n for n, _ in fields)])

    dealt = rows.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *order)
    schema = StructType([*rows.schema.fields, *added.fields])
    return dealt.mapInArrow(run, schema)


def fold_stream(stream: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict]], answers: str) -> DataFrame:
    """``fold`` over a stream: a key's state is kept between batches, and within a batch its rows are taken by ``order``.

    A row that comes in a later batch than one it should go before is taken after
    it: what a stream has answered stands. The rows of a key in one batch are held.
    """
    added = StructType.fromDDL(answers)
    names = [f.name for f in added]

    def run(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else start()
        rows = pd.concat(list(frames)).sort_values(order)
        found = []
        # nulls are None for the step, as in a fold
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            state, answer = step(state, row)
            found.append([answer.get(n) for n in names])
        held.update((pickle.dumps(state),))
        more = pd.DataFrame(found, columns=names, index=rows.index, dtype=object)
        yield pd.concat([rows, more], axis=1)

    schema = StructType([*stream.schema.fields, *added.fields])
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")
