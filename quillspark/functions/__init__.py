"""Column expressions and text functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of an Arrow batch that are Python objects at once.
SLICE = 256


def struct_of(**fields: T.DataType) -> T.StructType:
    """A struct type; built from objects, so that workers can import modules without a session."""
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[list, ...]]:
    """Columns of a batch as Python lists, ``SLICE`` rows at a time."""
    for i in range(0, len(columns[0]), SLICE):
        yield tuple(c.slice(i, SLICE).to_pylist() for c in columns)


def row_function(returns: T.DataType, columns: int = 1) -> Callable[[Callable], Callable[..., Column]]:
    """A function of a row's values as a column function (structs as dicts): a batch's results leave slice by slice."""
    kind = to_arrow_type(returns)

    def made(f: Callable) -> Callable[..., Column]:
        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for (values,) in slices((batch,)):
                    yield pa.array([f(v) for v in values], kind)

        def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                for values in slices(batch):
                    yield pa.array([f(*row) for row in zip(*values, strict=True)], kind)

        return F.arrow_udf(one if columns == 1 else several, returns)

    return made
