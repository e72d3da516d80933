"""Rows whose key occurs again, in one shuffle that no hot key can overload."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def repeated(df: DataFrame, key: str, *within: str) -> DataFrame:
    """The rows of df whose `key` (a long) occurs in another row too, and a few more.

    Rows are dealt out by ranges of (key, within), so a key that a third of all rows share is cut over many partitions;
    sorted rows then show in passing which keys repeat. What stands at the border of a partition may go on in the next
    one and is always kept: at most two keys a partition are in the result although they occur once.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, and whether the row before it has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            same = keys[1:] == keys[:-1]
            again = np.zeros(len(keys), dtype=bool)
            again[1:] |= same
            again[:-1] |= same
            if held is None:
                again[0] = True
            else:
                row, known = held
                if row.column(batch.schema.get_field_index(key))[0].as_py() == keys[0]:
                    again[0] = known = True
                if known:
                    yield row
            held = (batch.slice(len(keys) - 1, 1), bool(again[-1]))
            chosen = np.flatnonzero(again[:-1])
            if len(chosen):
                yield batch.take(pa.array(chosen))
        if held is not None:
            yield held[0]

    return df.repartitionByRange(key, *within).sortWithinPartitions(key, *within).mapInArrow(task, df.schema)
