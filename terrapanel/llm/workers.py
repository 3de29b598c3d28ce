"""What Python workers hold: tools kept from task to task, and texts of whole rows."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_held: dict = {}


def tool(name: Hashable, build: Callable):
    """The tool of that name, built if this worker does not hold it. A worker lives on from stage to stage and holds one tool at
    a time, as those of all stages would add up."""
    if name not in _held:
        forget()
        _held[name] = build()
    return _held[name]


def forget() -> None:
    """For steps without a tool: let go of the one that an earlier stage has left, and of memory that Arrow has spare."""
    _held.clear()
    pa.default_memory_pool().release_unused()


def rows_with_text(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """(row) of the columns, and the text beside it only if it is not in there as a string: a task holds its batch's texts once."""
    row = F.struct(*columns).alias("row")
    if text_col in columns and docs.schema[text_col].dataType == StringType():
        return docs.select(row)
    return docs.select(row, F.col(text_col).cast("string").alias("text"))


def text_column(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The texts of a batch of rows_with_text."""
    return batch["text"] if "text" in batch.schema.names else batch["row"].field(text_col)
