"""Canonical length-limited Huffman coding of token ids, and a block file format that uses it.

File format. A file set is one folder: `codebook` (id, length) and `records`, in ascending order of
(bucket, record). A record holds whole documents: their ids, token counts, the global position of its first
id, and `data`:

    magic 4 bytes "AFH1" | ids n: u64 | block: u32 | step: u32 | blocks b: u32 | byte offset of every block: b x u64
    | bit offset of every step-th id inside its block: u32 each, blocks in turn | payload

A block is `block` ids that begin at a byte of their own; any block can be decoded alone, and any `step` ids
of it from their checkpoint. The container is Parquet, so that writing is atomic on any store and survives
lost executors; `data` is ours.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from asterfold.llm.packing import ended
from asterfold.llm.shared import id_bounds, remove, scratch_path, shuffle_width, write_table
from asterfold.llm.tokens import encoder

MAGIC, HEAD = b"AFH1", struct.Struct("<4sQIII")
BLOCK, STEP, MAX_BITS = 65_536, 128, 16
RECORD_IDS = 1 << 19
#: What null ids count as when ranges are cut.
LEAST = -(1 << 63)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits (package-merge); 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    for _ in range(max_bits - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        row = both[by]
    lengths, take = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[:take] += 1
    out[order] = lengths
    return out


class Codebook:
    def __init__(self, lengths: np.ndarray):
        """Canonical codes: ascending by (length, id)."""
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.codes = np.zeros(len(lengths), np.uint64)
        span = np.uint64(1) << (MAX_BITS - self.lengths[order]).astype(np.uint64)
        at = np.cumsum(span) - span
        self.codes[order] = at >> (MAX_BITS - self.lengths[order]).astype(np.uint64)
        #: For every window of MAX_BITS bits: the id that it begins with. Windows that no code has stay 0.
        self.table = np.zeros(1 << MAX_BITS, np.uint32)
        self.table[: int(span.sum())] = np.repeat(order, span.astype(np.int64))
        self.steps = self.lengths[self.table]

    def encode(self, ids: np.ndarray, block: int = BLOCK, step: int = STEP) -> bytes:
        payload, offsets, marks, at = [], [], [], 0
        for start in range(0, len(ids), block):
            part = ids[start : start + block]
            sizes = self.lengths[part]
            if not sizes.all():
                raise ValueError("an id without a code")
            ends = np.cumsum(sizes)
            begin = ends - sizes
            word, shift = begin >> 5, (64 - sizes - (begin & 31)).astype(np.uint64)
            bits = self.codes[part] << shift
            n = int(ends[-1] + 31 >> 5) + 1
            out = np.bincount(word, weights=(bits >> np.uint64(32)).astype(np.float64), minlength=n)
            out[1:] += np.bincount(word, weights=(bits & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[: n - 1]
            data = out.astype(np.uint32).astype(">u4").tobytes()[: int(ends[-1]) + 7 >> 3]
            offsets.append(at)
            marks.append(begin[::step].astype("<u4"))
            payload.append(data)
            at += len(data)
        head = HEAD.pack(MAGIC, len(ids), block, step, len(offsets))
        return b"".join([head, np.array(offsets, "<u8").tobytes(), *(m.tobytes() for m in marks), *payload])

    @staticmethod
    def layout(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, int]:
        """(step, ids and byte offset of every block, bit offset of every checkpoint, where the payload begins)."""
        magic, n, block, step, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        at = HEAD.size
        offsets = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
        at += 8 * blocks
        sizes = np.minimum(block, n - block * np.arange(blocks))
        marks = np.frombuffer(data, "<u4", int((-(-sizes // step)).sum()), at).astype(np.int64)
        return step, sizes, offsets, marks, at + 4 * len(marks)

    def decode(self, data: bytes) -> np.ndarray:
        """All ids of a record."""
        step, sizes, offsets, marks, at = self.layout(data)
        return self._decode(np.frombuffer(data, np.uint8, offset=at), offsets, sizes, marks, step)

    def decode_block(self, data: bytes, number: int) -> np.ndarray:
        """The ids of one block, from its own bytes alone."""
        step, sizes, offsets, marks, at = self.layout(data)
        lanes = np.r_[0, np.cumsum(-(-sizes // step))]
        end = at + int(offsets[number + 1]) if number + 1 < len(offsets) else len(data)
        raw = np.frombuffer(data[at + int(offsets[number]) : end], np.uint8)
        return self._decode(raw, np.zeros(1, np.int64), sizes[number : number + 1], marks[lanes[number] : lanes[number + 1]], step)

    def _decode(self, raw: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, marks: np.ndarray, step: int) -> np.ndarray:
        """The stretches between checkpoints are decoded side by side, a table look-up for each id."""
        if not len(sizes):
            return np.zeros(0, np.uint32)
        lanes = -(-sizes // step)
        pad = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint32)
        wide = pad[:-2] << 16 | pad[1:-1] << 8 | pad[2:]
        bit = marks + 8 * np.repeat(offsets, lanes)
        # Every lane but the last of a block holds `step` ids; a short lane runs on and its surplus is cut off.
        out = np.empty((step, len(bit)), np.uint32)
        last = 8 * len(raw)
        for k in range(step):
            window = wide[bit >> 3] >> (8 - (bit & 7)).astype(np.uint32) & 0xFFFF
            out[k] = self.table[window]
            bit = np.minimum(bit + self.steps[window], last)
        index = np.arange(len(marks)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        keep = np.minimum(step, np.repeat(sizes, lanes) - step * index)
        return out.T[np.arange(step) < keep[:, None]]


def bucket_of(keys: np.ndarray, cuts: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The range of the ascending `cuts` that each key is in. A cut that is there several times is a key of so
    many rows that they fill several ranges; those rows are dealt among them by salt."""
    low, high = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
    return np.where(high - low > 1, low + 1 + salt % np.maximum(1, high - low), high).astype(np.int32)


def tokenized(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, cuts: list) -> DataFrame:
    """bucket, id, n_tokens, ids, counts. bucket: the range of `cuts` that the id is in; null ids come first of
    all. Besides its documents each task gives one row of bucket -1: how often each id of the vocabulary
    occurred in the task, as 64-bit integers."""
    id_type = df.schema[id_col].dataType.simpleString()
    bounds = np.array(cuts, np.int64)
    names = ["bucket", "id", "n_tokens", "ids", "counts"]

    def run(batches):
        enc = encoder(tokenizer)
        vocabulary = max(enc.vocabulary, end_id + 1)
        total = np.zeros(vocabulary, np.int64)
        kind = None
        for batch in batches:
            row, kind = 0, batch.column(0).type
            for sizes, ids in enc.column(batch.column(1)):
                total += np.bincount(ids, minlength=vocabulary)
                total[end_id] += len(sizes)
                own = batch.column(0).slice(row, len(sizes))
                row += len(sizes)
                keys = own.cast(pa.int64()).fill_null(LEAST).to_numpy(zero_copy_only=False)
                sizes, ids = ended(sizes, ids, end_id)
                salt = np.fromiter((zlib.crc32(x.as_buffer()) for x in ids), np.int64, len(ids)) if len(cuts) > len(set(cuts)) else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket_of(keys, bounds, salt)), own, pa.array(sizes), ids, pa.nulls(len(sizes), pa.binary())], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.nulls(1, kind), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"bucket int, id {id_type}, n_tokens long, ids binary, counts binary")


def id_counts(table: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs. Tasks add up the counts of the tasks before; the driver gets a number for each
    id of the vocabulary."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["token", "n"])

    rows = table.where("bucket = -1").select("counts").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[rows["token"].to_numpy(int)] = rows["n"].to_numpy(np.int64)
    return out


def write(df: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", step: int = STEP, block: int = BLOCK) -> None:
    """Encodes every text, appends end_id, and writes all ids to `path` in ascending order of id_col.

    id_col holds whole numbers. Null and empty texts are the end id alone; rows with a null id come first; rows
    of equal id follow each other, in the order of their ids unless they are so many that they fill several
    ranges. An empty table gives a file set without records; other columns are ignored, whatever their names.
    Documents meet in ranges of the id column, dealt to tasks in ascending order, so that part files ascend too:
    sorted streams, of which a task holds one record at a time, so that neither a hot range nor a document of
    any length is gathered with others.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col}: whole numbers")
    enc = encoder(tokenizer)
    vocabulary, width = max(enc.vocabulary, end_id + 1), enc.dtype
    cuts = id_bounds(df, id_col)
    written, scratch = write_table(tokenized(df, tokenizer, end_id, id_col, text_col, cuts), "ids")
    lengths = code_lengths(id_counts(written, vocabulary))
    table = written.where("bucket >= 0").drop("counts")
    totals = table.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect()
    ends = np.cumsum([r["n"] for r in totals], dtype=np.int64)
    offsets = {r["bucket"]: int(e) - r["n"] for r, e in zip(totals, ends, strict=True)}
    sent = spark.sparkContext.broadcast((lengths, offsets))
    id_type = table.schema["id"].dataType.simpleString()
    names = ["bucket", "record", "start", "ids", "tokens", "data"]

    def run(batches):
        lengths, offsets = sent.value
        book = Codebook(lengths)
        bucket, record, at, held, held_ids = None, 0, 0, [], 0

        def flush():
            nonlocal record, at, held, held_ids
            if not held:
                return
            ids = np.concatenate([np.frombuffer(raw, width) for _, raw in held])
            sizes = [len(raw) // enc_width for _, raw in held]
            row = [[bucket], [record], [at], [[i for i, _ in held]], [sizes], [book.encode(ids, block, step)]]
            record, at, held, held_ids = record + 1, at + len(ids), [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names)

        enc_width = np.dtype(width).itemsize
        types = [pa.int32(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            types[3] = pa.list_(batch.column(1).type)
            for b, i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != bucket or held_ids >= RECORD_IDS:
                    yield from flush()
                if b != bucket:
                    bucket, record, at = b, 0, offsets[b]
                held.append((i, raw.as_py()))
                held_ids += len(held[-1][1]) // enc_width
        yield from flush()

    tasks = shuffle_width(spark)
    dealt = table.repartitionById(tasks, (F.col("bucket").cast("long") * tasks / F.lit(len(cuts) + 1)).cast("int")).sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "ids")
    records = dealt.select("bucket", "id", "ids").mapInArrow(run, f"bucket int, record long, start long, ids array<{id_type}>, tokens array<long>, data binary")
    records.write.option("compression", "none").parquet(f"{path}/records")
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    remove(spark, scratch)


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of a file set: id_col, start, n_tokens, ids_crc32 (and ids, little-endian u32).
    Null and repeated ids come back as they were written; a set without records gives no rows."""
    rows = spark.read.parquet(f"{path}/codebook").toPandas()  # at most one row per id of the vocabulary
    lengths = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.uint8)
    lengths[rows["id"].to_numpy(int)] = rows["length"].to_numpy()
    sent = spark.sparkContext.broadcast(lengths)
    table = spark.read.parquet(f"{path}/records")
    id_type = table.schema["ids"].dataType.elementType.simpleString()
    names = ["id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4]

    def run(batches):
        book = Codebook(sent.value)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = book.decode(batch.column(3)[k].as_py()).astype("<u4")
                sizes = np.array(batch.column(2)[k].as_py(), np.int64)
                begins = np.cumsum(sizes) - sizes
                raw = ids.tobytes()
                parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
                arrays = [batch.column(1)[k].values, pa.array(begins + batch.column(0)[k].as_py()), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(parts, pa.binary())] if with_ids else [])], names)

    out = table.select("start", "ids", "tokens", "data").mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a file set to the shared folder and reads it back: see write and read for nulls, empty and very
    long texts, ties, repeated rows, empty tables and clashing columns."""
    path = scratch_path(df.sparkSession, "token_files")
    write(df, tokenizer, path, end_id, id_col, text_col)
    return read(df.sparkSession, path, id_col)
