"""Arrow record batches as Python rows."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa


def _values(column: pa.Array) -> list:
    # numpy's conversion is several times faster, but would turn null integers into floats.
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def rows(batch: pa.RecordBatch, names: list[str] | None = None) -> Iterable[tuple]:
    return zip(*[_values(batch.column(n)) for n in names or batch.schema.names])
