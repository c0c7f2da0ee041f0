"""BPE encoding and decoding of whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import prepare, table, texts


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text; null texts have no ids. Columns other than those two are left out."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(path)
        for batch in batches:
            ids = [np.frombuffer(coder.encode_all(t), "<u4").astype("i4") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give an empty text, an id outside the vocabulary fails."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(path)
        for batch in batches:
            out = ["".join(coder.decode([np.array(ids or [], "<u4").tobytes()])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text runs through encoder and decoder part by part.

    One row per input row, repeated rows too; a null or empty text has no tokens and the digests of nothing.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(path)
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column("text").to_pylist():
                of_ids, of_text, count = hashlib.sha256(), hashlib.sha256(), 0

                def tee() -> Iterator[bytes]:
                    nonlocal count
                    for part in coder.encode(text):  # noqa: B023  used up before the next text
                        of_ids.update(part)  # noqa: B023
                        count += len(part) // 4
                        yield part

                for piece in coder.decode(tee()):
                    of_text.update(piece.encode())
                n.append(count)
                ids.append(of_ids.hexdigest())
                back.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``documents``; see ``digests``.

    Whole texts of any length run through the transducer and back. A null or empty text has no ids; repeated rows and
    null ids are returned as they come; an empty table gives no rows; other columns are not read.
    """
    return digests(table(spark, sf_dir, "documents"), vocabulary())
