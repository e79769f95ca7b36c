"""Token counts of whole texts; huge texts by overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterfold.llm.tokens import Encoder, encoder

CHUNK, OVERLAP, LIMIT = 16_384, 256, 1_024
SPACES = " \t\n\r"
#: Characters whose class is the same for all pre-tokenizers: letters (Latin-1, kana, Han, Hangul), digits, marks.
L, N, M = "A-Za-zÀ-ÖØ-öø-ÿぁ-ゖァ-ヺ一-鿋가-힣", "0-9", "!-/:-@\\[-`{-~、。"
#: Where a word ends whatever lies further away: after a word and before white space, or between classes, but not
#: after an apostrophe that may be part of a contraction.
BETWEEN = rf"(?<=[{L}])(?=[{N}{M}])|(?<=[{N}])(?=[{L}{M}])|(?<=[{M}])(?<!')(?=[{L}{N}])"
SPACED = re.compile(rf"(?<=[{L}{N}{M}])(?=[{SPACES}])|{BETWEEN}")
PLAIN = re.compile(rf"(?<=[{SPACES}])|(?=[{SPACES}])|(?<=[{N}])(?=[{N}])|{BETWEEN}")


def stable(enc: Encoder, text: str, begin: int, end: int) -> Iterator[int]:
    """The positions from begin to end across which pre-tokenization can't depend (see tokens.py). Between
    classes an added token may span a position; such positions are left out."""
    if not enc.kind:
        return
    reach = enc.longest - 1
    for m in (SPACED if enc.kind == "spaced" else PLAIN).finditer(text, max(1, begin), min(len(text), end + 1)):
        p = m.start()
        if p >= end or p >= len(text):
            return
        if text[p] in SPACES or text[p - 1] in SPACES or not any(a.start() < reach < a.end() for a in enc.special.finditer(text[p - reach : p + reach] if p >= reach else " " * (reach - p) + text[: p + reach])):
            yield p


def splice(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """The ids of text, in parts.

    Each chunk is encoded with offsets, beginning `overlap` characters before the last one ended. The two
    are joined at the last position of the overlap at which both have a token boundary and which is proven
    stable. If there is none, the overlap doubles; once it would span the chunk, the chunk is made to reach
    beyond the next stable position instead, however far that is. So each character is encoded a few times at
    most, and no more is held than the longest stretch without such a position.
    """

    def run(a: int, b: int) -> tuple[list[int], np.ndarray]:
        e = enc.library.encode(text[a:b], add_special_tokens=False)
        return e.ids, np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids)) + a

    n, end, valid = len(text), min(chunk, len(text)), 0
    ids, starts = run(0, end)
    while end < n:
        wide, at = min(overlap, end - valid), None
        while True:
            good = list(stable(enc, text, max(valid, end - wide) + 1, end))
            if good:
                after = run(end - wide, nxt := min(n, end - wide + max(chunk, 2 * wide)))
                common = np.intersect1d(np.intersect1d(starts, after[1]), good)
                if len(common):
                    at = int(common[-1])
            if at is not None or wide >= end - valid:
                break
            wide = min(2 * wide, end - valid)
        if at is None:
            further = next(stable(enc, text, end + overlap, n), n)
            end = min(n, max(further + overlap, end + chunk))
            ids, starts = run(valid, end)
            continue
        first, last = np.searchsorted(starts, (valid, at))
        yield ids[first:last]
        (ids, starts), end, valid = after, nxt, at
    yield ids[int(np.searchsorted(starts, valid)) :]


def count_long(enc: Encoder, text: str, chunk: int, overlap: int) -> int:
    return sum(map(len, splice(enc, text, chunk, overlap)))


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Map-only: no shuffle. A text of over `chunk` characters is spliced, whatever its length; others are counted
    together. A null text counts as empty (0 bytes, 0 tokens); ids may be null or repeated, each row is counted;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    if not tokenizer.endswith(".json"):
        raise ValueError("tokenizer: a .json file of the tokenizers library")
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for row in range(0, batch.num_rows, 2048):
                part = batch.slice(row, 2048)
                texts = part.column(1).fill_null("")
                counts = np.zeros(len(texts), np.int64)
                long_ = pc.greater(pc.utf8_length(texts), chunk)
                counts[:] = [x for sizes, _ in enc.column(pc.if_else(long_, "", texts)) for x in sizes.tolist()]
                for i in np.flatnonzero(long_.to_numpy(zero_copy_only=False)).tolist():
                    counts[i] = count_long(enc, texts[i].as_py(), chunk, overlap)
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
