"""SentencePiece (BPE with byte fallback) encoding and decoding by suffix-array matching.

Text is cut between neighbours that no piece joins (so before every run of space marks): no edge can cross there,
and what lies between two cuts, a chunk, is encoded apart. The distinct chunks of a batch are concatenated and
their suffixes sorted, by ranks of prefixes that double in length; every piece of the vocabulary is searched for
in that array at once, which gives the range of suffixes that begin with it. The ranges' occurrences, put in
order of position by a table, are the edges of the batch; relaxation then joins, in every chunk, the two
neighbours whose joint edge scores best (the leftmost of equals) until no joint edge is left.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters of distinct chunks that are indexed at once, the longest chunk relaxed side by side with others,
#: and the chunks that a worker remembers (if of MEMO_CHARS characters at most).
BATCH, LONG, MEMO, MEMO_CHARS = 400_000, 48, 600_000, 40
#: Characters of text that are cut and put together at once.
WINDOW = 2_000_000
NONE = np.iinfo(np.int32).max


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece has a space mark after other characters")
        self.byte_ids = np.zeros(256, np.int64)
        bytes_of: list[bytes] = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(names[i][3:-1], 16)
                self.byte_ids[value] = i
                bytes_of[i] = bytes([value])
            elif not model.is_control(i):
                bytes_of[i] = names[i].replace(SPACE, " ").encode() if not model.is_unknown(i) else " ⁇ ".encode()
        self.bytes_of = pa.array(bytes_of, pa.large_binary())
        self.spaced = {i for i in plain if names[i][0] == SPACE}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.code = self._numbers({c for i in plain for c in names[i]})
        self.width = max(len(names[i]) for i in plain)
        #: Neighbours that some piece joins, by numbers of their own for either side.
        pairs = {pair for i in plain for pair in zip(names[i], names[i][1:])}  # noqa: B905
        self.left, self.right = self._numbers({a for a, _ in pairs}), self._numbers({b for _, b in pairs})
        self.joined = np.zeros((int(self.left.max()) + 1, int(self.right.max()) + 1), bool)
        for a, b in pairs:
            self.joined[self.left[ord(a)], self.right[ord(b)]] = True
        #: Places of the pieces' scores, the best first, equal ones alike; the last is that of no piece.
        self.rank = np.full(n + 1, NONE, np.int64)
        self.rank[plain] = np.unique([-model.get_score(i) for i in plain], return_inverse=True)[1]
        low = np.zeros((len(plain), self.width), np.uint16)
        for row, i in zip(low, plain, strict=True):
            row[: len(names[i])] = self.code[self._points(names[i])]
        order = np.argsort(self._key(low), kind="stable")
        low, self.ids = low[order], np.array(plain)[order]
        self.lengths = np.array([len(names[i]) for i in self.ids])
        high = np.where(np.arange(self.width) < self.lengths[:, None], low, 0xFFFF).astype(np.uint16)
        self.low, self.high = self._key(low), self._key(high)
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), "<u4")

    @staticmethod
    def _numbers(characters: set[str]) -> np.ndarray:
        """Code point -> number of the character from 1, in their order; 0 for all others."""
        out = np.zeros(0x110000, np.uint16)
        out[sorted(map(ord, characters))] = np.arange(1, len(characters) + 1)
        return out

    @staticmethod
    def _key(codes: np.ndarray) -> np.ndarray:
        """Rows of codes as byte strings that sort like them."""
        return np.ascontiguousarray(codes.astype(">u2")).view(f"S{2 * codes.shape[1]}")[:, 0]

    def _sorted(self, padded: np.ndarray, n: int) -> np.ndarray:
        """The first n positions, ordered by the `width` codes from there on."""
        wide = np.concatenate([padded, np.zeros(4, np.uint16)]).astype(np.uint64)
        key = wide[:n] << 48 | wide[1 : n + 1] << 32 | wide[2 : n + 2] << 16 | wide[3 : n + 3]
        reach = 4
        while True:
            array = np.argsort(key)
            if reach >= self.width:
                return array
            ordered = key[array]
            rank = np.zeros(n + reach, np.uint64)
            rank[array] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
            key = rank[:n] << 32 | rank[reach:]
            reach *= 2

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """(positions, lengths) -> the id of the piece there or -1, from a suffix array over codes."""
        padded = np.concatenate([codes, np.zeros(self.width, np.uint16)])
        array = self._sorted(padded, len(codes))
        ordered = self._key(np.lib.stride_tricks.sliding_window_view(padded, self.width)[: len(codes)])[array]
        first, last = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        count = last - first
        piece = np.repeat(np.arange(len(count)), count)
        at = array[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        table = np.full((len(codes) + 1, self.width + 1), -1, np.int32)
        table[at, self.lengths[piece]] = self.ids[piece]
        return table

    def relax(self, chunks: list[str]) -> list[bytes]:
        """The ids of every chunk, as little-endian 32-bit integers."""
        text = "".join(chunks)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(size)
        # Chunks are kept apart by a code that no piece has: no joint reaches from one to the next.
        place = np.arange(len(text)) + np.repeat(np.arange(len(chunks)), size)
        spread = np.zeros(len(text) + len(chunks), np.uint16)
        spread[place] = self.code[self._points(text)]
        table = self.edges(spread)
        long_ = size > LONG
        own = {int(c): self._filled(text, int(c), *self._relax_long(table, int(ends[c] - size[c] + c), int(size[c])), table) for c in np.flatnonzero(long_)}
        start, width, count = self._relaxed(table, place[~np.repeat(long_, size)], size[~long_])
        piece = table[start, width]
        total = np.zeros(len(chunks), np.int64)
        total[~long_] = count
        last = np.cumsum(total)
        for c in np.unique(np.searchsorted(last, np.flatnonzero(piece < 0), "right")).tolist():
            here = slice(int(last[c] - total[c]), int(last[c]))
            own[c] = self._filled(text, c, start[here], width[here], table)
        raw, cut = piece.astype("<u4").tobytes(), (4 * np.r_[0, last]).tolist()
        out = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for c, ids in own.items():
            out[c] = ids
        return out

    def _relaxed(self, table: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, width) of the symbols that are left of chunks of `count` characters each, and how many each chunk has."""

        def joints(i: np.ndarray) -> np.ndarray:
            """Rank and start of the joint of symbol i and the next, as one number."""
            total = width[i] + width[i + 1]
            return self.rank[table[start[i], np.where(total <= self.width, total, 0)]] << 32 | start[i]

        width, chunk, left = np.ones(len(start), np.int64), np.arange(len(count)), count.copy()
        key = np.full(len(start), NONE << 32)
        key[:-1] = joints(np.arange(len(start) - 1))
        settled = [(start[:0], width[:0])]
        while len(start):
            best = np.minimum.reduceat(key, np.cumsum(count) - count)
            more = best < NONE << 32
            if not more.all():
                alive = np.repeat(more, count)
                settled.append((start[~alive], width[~alive]))
                start, width, key, chunk, count, best = start[alive], width[alive], key[alive], chunk[more], count[more], best[more]
            top = np.flatnonzero(key == np.repeat(best, count))
            width[top] += width[top + 1]
            keep = np.ones(len(start), bool)
            keep[top + 1] = False
            start, width, key, count = start[keep], width[keep], key[keep], count - 1
            left[chunk] = count
            top -= np.arange(len(top))
            near = np.concatenate([top, top[top > 0] - 1])
            key[near[near == len(start) - 1]] = NONE << 32
            near = near[near < len(start) - 1]
            key[near] = joints(near)
        start, width = (np.concatenate(x) for x in zip(*settled, strict=True))
        order = np.argsort(start)
        return start[order], width[order], left

    def _filled(self, text: str, chunk: int, start: np.ndarray, width: np.ndarray, table: np.ndarray) -> bytes:
        """Ids of the symbols, bytes for characters without a piece."""
        ids: list[int] = []
        for a, w in zip(start.tolist(), width.tolist(), strict=True):
            i = int(table[a, w])
            ids.extend([i] if i >= 0 else self.byte_ids[list(text[a - chunk : a - chunk + w].encode())].tolist())
        return np.array(ids, "<u4").tobytes()

    def _relax_long(self, table: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One long chunk, with a heap over its joints."""
        after, before, width = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (total := width[i] + width[after[i]]) <= self.width and (p := int(table[first + i, total])) >= 0:
                heapq.heappush(heap, (int(self.rank[p]), i, total))

        for i in range(n):
            offer(i)
        while heap:
            _, i, total = heapq.heappop(heap)
            if not width[i] or after[i] >= n or width[i] + width[after[i]] != total:
                continue
            gone = after[i]
            width[i], width[gone], after[i] = total, 0, after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        kept = np.array([i for i in range(n) if width[i]])
        return kept + first, np.array([width[i] for i in kept])

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of every text, as little-endian 32-bit integers."""
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= WINDOW:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        text = "".join(marked)
        bounds = np.cumsum([0, *map(len, marked)])
        points = self._points(text)
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.joined[self.left[points[:-1]], self.right[points[1:]]]
        cut[bounds] = True
        raw = text.encode()
        cuts = np.flatnonzero(cut)
        begins = np.flatnonzero(np.frombuffer(raw + b" ", np.uint8) & 0xC0 != 0x80)[cuts]
        column = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(begins), pa.py_buffer(raw)).dictionary_encode()
        ids = pa.array(self._looked_up(column.dictionary.to_pylist()), pa.large_binary()).take(column.indices)
        yield from _slices(ids, np.searchsorted(cuts, bounds))

    def _looked_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks, remembered or relaxed."""
        out = list(map(self.memo.get, chunks))
        missing = [k for k, ids in enumerate(out) if ids is None]
        at = 0
        while at < len(missing):
            begin, size = at, 0
            while at < len(missing) and (at == begin or size + len(chunks[missing[at]]) <= BATCH):
                size += len(chunks[missing[at]])
                at += 1
            part = missing[begin:at]
            for k, ids in zip(part, self.relax([chunks[k] for k in part]), strict=True):
                out[k] = ids
        if len(self.memo) + len(missing) > MEMO:  # begun anew, with the chunks at hand
            self.memo.clear()
            missing = range(min(len(chunks), MEMO))
        self.memo.update((chunks[k], out[k]) for k in missing if len(chunks[k]) <= MEMO_CHARS)
        return out

    def decode(self, raw: bytes) -> str:
        return next(self.decode_all([raw]))

    def decode_all(self, raws: list[bytes]) -> Iterator[str]:
        """The texts that ids stand for. Bytes that are no UTF-8 become U+FFFD; control ids are nothing."""
        ids = np.frombuffer(b"".join(raws), "<u4")
        bounds = np.cumsum([0, *map(len, raws)]) // 4
        for a, text in zip(bounds.tolist(), _slices(self.bytes_of.take(pa.array(ids)), bounds), strict=False):
            lead = next((i for i in ids[a : a + 8].tolist() if i not in self.control), None) if text else None
            yield (text[1:] if lead in self.spaced else text).decode("utf-8", "replace")


def _slices(column: pa.LargeBinaryArray, bounds: np.ndarray) -> Iterator[bytes]:
    """The values from each bound to the next, joined."""
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1)[bounds].tolist() if len(column) else [0] * len(bounds)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield values[a:b].to_pybytes() if b > a else b""


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (binary, little-endian u32) for every row. Null and empty texts have no ids."""

    def run(batches):
        enc = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(enc.encode(t or "" for t in part.column(1).to_pylist())), pa.binary())], ["id", "ids"])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {_id_type(df, id_col)}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text for every row of ids; null ids give an empty text."""

    def run(batches):
        enc = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(enc.decode_all([x or b"" for x in part.column(1).to_pylist()])), pa.string())], ["id", "text"])

    picked = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(run, f"id {_id_type(df, id_col)}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_crc32, decoded_crc32, same (whether decoding gave the text again) for every row.

    One pass over whole texts of any length, without a shuffle; what takes memory (some 320 bytes a character) is a
    batch of different chunks, or a longer stretch without a space that pieces may join throughout. A null or empty
    text has no ids; ids may be null or repeated, each row is encoded; an empty table gives no rows; other columns
    are ignored, whatever their names. Of joints that score equally the leftmost is taken. A literal space mark
    (U+2581) in a text decodes to a space, as in the library.
    """

    def run(batches):
        enc = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                raws = list(enc.encode(texts))
                back = list(enc.decode_all(raws))
                columns = [pa.array([len(x) // 4 for x in raws], pa.int64()), pa.array([zlib.crc32(x) for x in raws], pa.int64()), pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_tokens", "ids_crc32", "decoded_crc32", "same"])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {_id_type(df, id_col)}, n_tokens long, ids_crc32 long, decoded_crc32 long, same boolean").withColumnRenamed("id", id_col)
