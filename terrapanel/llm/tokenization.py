"""Encoding and decoding whole texts with a SentencePiece BPE model, as narrow Spark steps.

Null counts as empty text, which encodes to begin and end only. Rows are handled alone: repeated rows repeat their
result, and texts of any length are encoded whole. The model file is read on the driver and broadcast (a vocabulary
file of some hundred kB); each Python worker builds its tables from it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from terrapanel.llm.pieces import Decoder, Encoder, Model
from terrapanel.llm.workers import rows_with_text, text_column, tool

BATCH_BYTES = 8_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def shared_model(spark: SparkSession, path: str | None) -> Broadcast:
    with open(path or default_model(), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _tools(shared: Broadcast) -> tuple[Encoder, Decoder]:
    data = shared.value

    def build() -> tuple[Encoder, Decoder]:
        model = Model(data)
        return Encoder(model), Decoder(model)

    return tool(("pieces", data), build)


def _encoded(
    batches: Iterator[pa.RecordBatch], shared: Broadcast, decoded: bool, text_col: str = "text"
) -> Iterator[pa.RecordBatch]:
    """The batches' columns, text aside, with packed ids and, if asked for, the decoded text."""
    encoder, decoder = _tools(shared)
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "text"]
        start, size, packed, texts = 0, 0, [], []
        for at, value in enumerate(text_column(batch, text_col), 1):
            packed.append(encoder.encode(value.as_py() or ""))
            if decoded:
                texts.append(decoder.decode(np.frombuffer(packed[-1], "<u4").tolist()))
            size += len(packed[-1])
            if size >= BATCH_BYTES or at == len(batch):
                part = batch.slice(start, at - start)
                made = [pa.array(packed, pa.binary())] + [pa.array(texts, pa.string())] * decoded
                yield pa.RecordBatch.from_arrays(
                    [part[c] for c in kept] + made, kept + ["packed_ids", "decoded"][: len(made)]
                )
                start, size, packed, texts = at, 0, [], []


def round_trip(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, packed_ids, decoded): ids as little-endian 32-bit numbers, and the text they decode to."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = shared_model(docs.sparkSession, model_path)
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        lambda batches: _encoded(batches, shared, True), f"doc_id {kind}, packed_ids binary, decoded string"
    )


def _with_ids(batches: Iterator[pa.RecordBatch], shared: Broadcast, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in _encoded(batches, shared, False, text_col):
        ids = [np.frombuffer(x.as_py(), "<i4") for x in batch["packed_ids"]]
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(ids, pa.list_(pa.int32()))], ["row", "ids"])


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """All columns of the rows, with `ids` (array of int; a column of that name is replaced)."""
    names = [c for c in docs.columns if c != "ids"]
    rows = rows_with_text(docs, names, text_col)
    shared = shared_model(docs.sparkSession, model_path)
    schema = StructType([rows.schema["row"], StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(lambda batches: _with_ids(batches, shared, text_col), schema).select("row.*", "ids")


def _decoded(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    decoder = _tools(shared)[1]
    for batch in batches:
        texts = [decoder.decode(ids or []) for ids in batch["ids"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], ["row", "decoded"])


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """All columns of the rows with `ids`, and `decoded` (a column of that name is replaced); null ids decode to ''."""
    names = [c for c in rows.columns if c != "decoded"]
    shared = shared_model(rows.sparkSession, model_path)
    plain = rows.select(F.struct(*names).alias("row"), "ids")
    schema = StructType([plain.schema["row"], StructField("decoded", StringType())])
    return plain.mapInArrow(lambda batches: _decoded(batches, shared), schema).select("row.*", "decoded")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of a round trip."""
    return found.select(
        "doc_id",
        F.floor(F.octet_length("packed_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("packed_ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
