"""Ordered folds over bounded groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that a fold hands back.
_OUT = 10_000


def fold(df: DataFrame, order: list[str], run: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of schema that run makes of each group of df by its first column, its rows in order.

    One shuffle by the group, then sorted partitions are streamed: a task holds one group at a time, and
    no frame is built for each group, which small groups would pay for dearly.
    """
    key = df.columns[0]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        out: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            out.extend(run(list(group)))
            if len(out) >= _OUT:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(go, schema)
