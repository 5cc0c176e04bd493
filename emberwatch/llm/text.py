"""Small helpers for text inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = " \t\n\x0b\x0c\r"


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text; a null is an empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def per_batch(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str
) -> DataFrame:
    """Map Arrow batches, given as lists by column, to lists of the columns of `schema`."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds: pa.Schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                out = function(part.to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[field.name], field.type) for field in kinds], schema=kinds
                )

    return df.mapInArrow(run, schema)


def runs(texts: Sequence[str | None], most_chars: int = 1_000_000) -> Iterator[slice]:
    """Slices of consecutive texts with at most so many characters, or one longer text."""
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars > most_chars and i > start:
            yield slice(start, i)
            start, chars = i, len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


#: Rows handled at a time inside a task; bounds memory, never changes a result.
ROWS = 500
