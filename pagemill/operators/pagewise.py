"""Python folds over the items of one page, many pages to an Arrow batch.

The JVM groups a page's items to one row (``collect_list``), Python gets whole batches of pages.
That spares the per-group set-up of ``applyInPandas``. A page is the unit that must fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def gathered(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "items") -> DataFrame:
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias(name))


def rows_of(batch: pa.RecordBatch, at_once: int = 64) -> Iterator[tuple]:
    """Rows as Python values, few at once: they take many times the room of their batch."""
    for i in range(0, batch.num_rows, at_once):
        yield from zip(*(c.to_pylist() for c in batch.slice(i, at_once).columns), strict=True)


def fold(grouped: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str | T.StructType) -> DataFrame:
    """``fn(*columns of one row)`` yields output tuples; columns come as Python values."""
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for row in rows_of(b):
                rows.extend(fn(*row))
                if len(rows) >= 50_000:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)

    return grouped.mapInArrow(run, struct)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
