"""Arrow batches of rows that are large, as files are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def parts(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes, one row at least, so that what a task makes
    of a batch doesn't depend on how large its rows are."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for i in range(0, batch.num_rows, step):
            yield from halves(batch.slice(i, step), 2 * limit)


def halves(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch may be of very unlike sizes: what is still too large is cut again."""
    if batch.num_rows < 2 or batch.get_total_buffer_size() == 0 or batch.nbytes <= limit:
        yield batch
    else:
        yield from halves(batch.slice(0, batch.num_rows // 2), limit)
        yield from halves(batch.slice(batch.num_rows // 2), limit)


def row_by_row(make: Callable[[dict], dict], kinds: dict[str, DataType], limit: int = 32 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: makes a row of each row, with columns of these kinds. A batch goes out when
    its strings and bytes have `limit` bytes."""
    schema = pa.schema([(name, to_arrow_type(kind)) for name, kind in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                rows.append(make(batch.slice(i, 1).to_pylist()[0]))
                size += sum(len(x) for x in rows[-1].values() if isinstance(x, str | bytes))
                if size >= limit:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run
