"""Order, offset pages and keyset pages."""

from __future__ import annotations

import base64
import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ORDERS = 8


def order_columns(orders: list[tuple[str, str]], keys: tuple[str, ...] = ("partition_key", "id"), nulls_last: bool = False) -> list[Column]:
    """Order by (column, "asc" or "desc"), then by the keys that are not named yet. Nulls come first upwards and last downwards, or last both ways."""
    if len(orders) > MOST_ORDERS:
        raise ValueError("too many order expressions")
    named = [*orders, *((k, "asc") for k in keys if k not in {c for c, _ in orders})]
    way = lambda c, d: (c.desc_nulls_last() if nulls_last else c.desc()) if d.lower() == "desc" else (c.asc_nulls_last() if nulls_last else c.asc())
    return [way(F.col(c), d) for c, d in named]


def mixed_order(node: Column, descending: bool = False) -> list[Column]:
    """Order of JSON values of any type (a variant): nulls, numbers with truth values as 0 and 1, then texts, then the JSON of all else."""
    kind = F.schema_of_variant(node)
    number = F.coalesce(F.try_variant_get(node, "$", "boolean").cast("double"), F.try_variant_get(node, "$", "double"))
    is_text = kind == "STRING"
    is_number = kind.rlike("^(BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL)")
    text = F.when(is_text, F.try_variant_get(node, "$", "string")).otherwise(F.to_json(node))
    missing = node.isNull() | F.is_variant_null(node)
    group = F.when(missing, 0).when(is_number, 1).when(is_text, 2).otherwise(3)
    parts = [group, F.when(is_number, number), F.when(~missing & ~is_number, text)]
    return [p.desc() if descending else p.asc() for p in parts]


def encode_token(offset: int) -> str:
    return base64.b64encode(str(offset).encode()).decode()


def decode_token(token: str | None) -> int:
    return int(base64.b64decode(token)) if token else 0


def page(df: DataFrame, orders: list[tuple[str, str]], limit: int, token: str | None = None, keys: tuple[str, ...] = ("partition_key", "id")) -> DataFrame:
    """The page's rows with ``position`` and ``next_token``, null on the last page.

    One row more than the page tells whether another follows; ordering and limit
    run as one top-k.
    """
    offset = decode_token(token)
    probe = df.orderBy(*order_columns(orders, keys)).offset(offset).limit(limit + 1)
    from pyspark.sql.window import Window

    ordered = Window.orderBy(*order_columns(orders, keys))
    rows = probe.withColumn("position", F.row_number().over(ordered) + F.lit(offset))
    more = F.max("position").over(Window.partitionBy()) > offset + limit
    return rows.withColumn("next_token", F.when(more, F.lit(encode_token(offset + limit)))).filter(F.col("position") <= offset + limit)


def after(keys: list[tuple[str, str]], last: list) -> Column:
    """Rows behind the last one seen in keyset order: (column, direction) pairs with their last values."""
    tests = []
    for k, (name, way) in enumerate(keys):
        same = [F.col(c) == F.lit(v) for (c, _), v in zip(keys[:k], last[:k], strict=True)]
        beyond = F.col(name) < F.lit(last[k]) if way == "desc" else F.col(name) > F.lit(last[k])
        tests.append(functools.reduce(operator.and_, [*same, beyond]))
    return functools.reduce(operator.or_, tests)
