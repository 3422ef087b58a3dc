"""Small helpers for mapInArrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows go to Python and back in pieces of about this many bytes, so that long texts do not pile up in a batch.
PIECE_BYTES = 8 << 20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or a field of a struct column as 'column.field'."""
    outer, _, inner = name.partition(".")
    return pc.struct_field(batch.column(outer), inner) if inner else batch.column(outer)


def pieces(batches: Iterator[pa.RecordBatch], sized: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `sized` column holds about `limit` bytes; a longer text is a batch by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(column(batch, sized)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def keyed(docs: DataFrame, key: str, text: str, carry: list[str] | None) -> tuple[DataFrame, str]:
    """`_key` (a struct of the key or of the carried columns) and the name under which the text is found: it is not sent twice."""
    own = carry or [key]
    frame = docs.select(F.struct(*[docs[c] for c in own]).alias("_key"), *([] if text in own else [docs[text].alias("_text")]))
    return frame, f"_key.{text}" if text in own else "_text"


def carried(key: str, carry: list[str] | None) -> Column:
    """What stands for a document in a result: its key, or the carried columns as one struct `row`, so that their names clash with no others."""
    return F.col("_key").alias("row") if carry else F.col("_key").getField(key).alias(key)


def make(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
