"""Concatenate-and-cut packing of token ids into sequences of a fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterfold.llm.shared import write_table
from asterfold.llm.tokens import encoder

LENGTH = 4_096


def ended(sizes: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, pa.Array]:
    """(how many ids each text has with end_id after its own, the ids as one binary value for each text)."""
    with_end = np.insert(ids, np.cumsum(sizes), end_id)
    sizes = sizes + 1
    offsets = np.r_[0, np.cumsum(sizes)] * ids.itemsize
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(with_end.tobytes())])
    return sizes, values.cast(pa.binary())


def tokenized(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """part, local_start (ids before it in its partition), n_tokens (with end_id), ids, id."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            row = 0
            for sizes, ids in enc.column(batch.column(1)):
                sizes, ids = ended(sizes, ids, end_id)
                local = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int32)), pa.array(local), pa.array(sizes), ids, batch.column(0).slice(row, len(sizes))], ["part", "local_start", "n_tokens", "ids", "id"])
                row += len(sizes)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"part int, local_start long, n_tokens long, ids binary, id {id_type}")


def pack(df: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pass one encodes each text, appends end_id, and writes ids with their place inside their partition; the
    partitions' totals are summed to global offsets (one number per partition goes to the driver). Pass two
    cuts the one long stream into windows of `length`: a row is the part of a document in one window. Nothing
    is shuffled, so a hot source or a huge document moves no data. Only the very last sequence is short.
    A null or empty text is the end id alone; a text of any length is cut into as many pieces as it needs;
    repeated or null ids stay apart as rows; an empty table gives no rows; other columns are ignored, whatever
    their names. With with_ids the rows also hold their ids (binary, little-endian unsigned 32-bit).
    """
    id_type = df.schema[id_col].dataType.simpleString()
    ids, _ = write_table(tokenized(df, tokenizer, end_id, id_col, text_col), "ids")
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r["n"] for r in totals], dtype=np.int64)
    offsets = {r["part"]: int(e) - r["n"] for r, e in zip(totals, ends, strict=True)}
    sent = df.sparkSession.sparkContext.broadcast(offsets)
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 8 if with_ids else 7]

    def run(batches):
        kind = encoder(tokenizer).dtype
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                size = part.column(2).to_numpy()
                begin = np.array([sent.value[p] for p in part.column(0).to_pylist()], np.int64) + part.column(1).to_numpy()
                window = begin // length
                count = (begin + size - 1) // length - window + 1
                owner = np.repeat(np.arange(len(size)), count)
                window = window[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                a = np.maximum(begin[owner], window * length)
                b = np.minimum((begin + size)[owner], (window + 1) * length)
                # The ids of the whole slice are one array; a piece is a stretch of it.
                values = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in part.column(3)]).astype("<u4")
                place = (np.cumsum(size) - size)[owner] + a - begin[owner]
                pieces = [values[i : i + n].data.cast("B") for i, n in zip(place.tolist(), (b - a).tolist(), strict=True)]
                columns = [a - begin[owner], b - a, np.fromiter(map(zlib.crc32, pieces), np.int64, len(pieces)), size[owner], window, a - window * length]
                arrays = [part.column(4).take(pa.array(owner)), *map(pa.array, columns)]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(map(bytes, pieces), pa.binary())] if with_ids else [])], names)

    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ids.select("part", "local_start", "n_tokens", "ids", "id").mapInArrow(run, schema).withColumnRenamed("id", id_col)
