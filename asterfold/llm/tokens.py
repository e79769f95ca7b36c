"""Token ids as the `tokenizers` library gives them, made once for each distinct word of a stretch of text.

Text is cut into the words of the tokenizer's own pre-tokenizer. For ASCII and Latin-1 letters the rule is
applied here, to all bytes of a stretch at once, and the distinct words are merged side by side. What holds
other characters, an added token or a very long word goes to the library: a byte-level pre-tokenizer never lets
a match cross from a non-space character to a white-space one, and a word pre-tokenizer drops white space
altogether, so that text may be cut at those places without changing an id. Texts with unusual white space,
and all texts of tokenizers of other shapes, are encoded whole. Nothing is kept from one stretch to the next.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters whose class as white space differs between engines or which are rare: such texts are not cut.
UNUSUAL = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
UNUSUAL_SPACE = re.compile(f"[{UNUSUAL}]")
#: The same in UTF-8.
UNUSUAL_BYTES = re.compile(b"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")
#: What the word pre-tokenizer must be to be applied here; the byte-level one has no parameters.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text handled at once, and the longest word that is merged here.
WINDOW, LONGEST = 4_000_000, 64
SPACE, LETTER, DIGIT, MARK, FOREIGN = range(5)


def _byte_classes() -> np.ndarray:
    out = np.full(256, FOREIGN, np.uint8)
    out[0x21:0x7F] = MARK
    out[list(b"0123456789")] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[list(b" \t\n\r")] = SPACE
    return out


CLASS = _byte_classes()
NONE = np.iinfo(np.int32).max


class Merges:
    """Byte-pair merges of many words at once."""

    SLOTS = 18

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}  # bytes that are written as themselves
        others = iter(range(0x100, 0x200))
        printed = [chr(b) if b in own else chr(next(others)) for b in range(256)]
        self.first = np.array([vocabulary[c] for c in printed], np.int32)
        self.last = np.array([vocabulary[c + suffix] for c in printed], np.int32)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        while len(pairs) * 4 > 1 << self.SLOTS:  # a quarter full at most
            self.SLOTS += 1
        self.keys = np.full(1 << self.SLOTS, -1, np.int64)
        self.ranks = np.full(1 << self.SLOTS, NONE, np.int32)
        keys = np.array([vocabulary[a] << 24 | vocabulary[b] for a, b in pairs], np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.keys[slot] >= 0:
                slot = slot + 1 & len(self.keys) - 1
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NONE without one."""
        key = a.astype(np.int64) << 24 | b
        slot = self._slots(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], NONE)
        missed = np.flatnonzero((there != key) & (there >= 0))
        while len(missed):
            slot[missed] = slot[missed] + 1 & len(self.keys) - 1
            there = self.keys[slot[missed]]
            same = there == key[missed]
            out[missed[same]] = self.ranks[slot[missed[same]]]
            missed = missed[~same & (there >= 0)]
        return out

    def words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each has) of words of `size` bytes each. In each round every word
        merges its leftmost pair of least rank; words without one are set aside."""
        ends = np.cumsum(size)
        ids = self.first[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        place = np.arange(len(ids), dtype=np.int32)
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        rank = np.full(len(ids), NONE, np.int32)
        rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[ends - 1] = NONE
        settled = []
        while len(ids):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, begin)
            count = np.diff(np.r_[begin, len(ids)])
            more = best < NONE
            if not more.all():
                alive = np.repeat(more, count)
                settled.append((place[~alive], ids[~alive], owner[~alive]))
                ids, place, owner, rank, best, count = ids[alive], place[alive], owner[alive], rank[alive], best[more], count[more]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, count))
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, place, owner, rank = ids[keep], place[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))
            near = np.concatenate([at, at[at > 0] - 1])
            near = near[near < len(ids) - 1]
            new = np.where(owner[near] == owner[near + 1], self.rank(ids[near], ids[near + 1]), NONE)
            rank[near] = new
            rank[-1] = NONE
        if not settled:
            return np.zeros(0, np.int32), size
        place, ids, owner = (np.concatenate(x) for x in zip(*settled, strict=True))
        return ids[np.argsort(place, kind="stable")], np.bincount(owner, minlength=len(size))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.vocabulary <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = cut_kind(spec)
        self.lowers = any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        contents = [t["content"] for t in spec.get("added_tokens") or []]
        self.longest = max(map(len, contents), default=1)
        self.special = re.compile("|".join(map(re.escape, contents)) or r"(?!)")
        self.added = re.compile(b"|".join(re.escape(c.encode()) for c in contents) or rb"(?!)")
        model = spec["model"]
        usual = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        known = self.kind == "spaced" or self.kind == "plain" and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == PLAIN_PATTERN
        if not (usual and known):
            self.kind = ""
        else:
            self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class of each byte, whether a word begins there, whether it is in a word for the library) of texts
        that begin and end at `bounds`."""
        n = len(data)
        kind = CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0xBF) & (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        for m in self.added.finditer(data):
            kind[m.start() : m.end()] = FOREIGN
        first = np.zeros(n + 4, bool)
        first[bounds] = True
        space = kind == SPACE
        cut = first.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        if self.kind == "plain":
            cut[:n] |= kind == DIGIT
        else:  # the last white space before a word is a word of its own, or part of the word if it is a space
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
            cut[last] = True
            cut[last[data[last] == 0x20] + 1] = False
        quote = np.flatnonzero(data == 0x27)
        if len(quote):
            quote = quote[cut[quote] & ~first[quote + 1]]
            after = np.r_[data, np.zeros(4, np.uint8)]
            one, two = after[quote + 1], after[quote + 2]
            if self.lowers:
                one, two = one | 0x20, two | 0x20
            short = quote[np.isin(one, list(b"stmd"))]
            pair = one.astype(np.int64) << 8 | two
            long_ = quote[np.isin(pair, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]) & ~first[quote + 2]]
            cut[short + 1] = cut[long_ + 1] = False
            cut[short + 2] = cut[long_ + 3] = True
        foreign = kind == FOREIGN
        if foreign.any():
            piece = first[:n].copy()
            piece[1:] |= (space[1:] & ~space[:-1]) | ((space[1:] != space[:-1]) if self.kind == "plain" else False)
            number = np.cumsum(piece, dtype=np.int32) - 1
            bad = np.zeros(int(number[-1]) + 1, bool)
            bad[number[foreign]] = True
            foreign = bad[number]
            cut[:n] = np.where(foreign, piece, cut[:n])
            if self.kind == "spaced":
                texts = {int(np.searchsorted(bounds, m.start(), side="right")) for m in UNUSUAL_BYTES.finditer(data)}
                for t in texts:
                    a, b = bounds[t - 1], bounds[t]
                    cut[a + 1 : b], foreign[a:b] = False, True
        return kind, cut[:n], foreign

    def _lowered(self, data: np.ndarray, kind: np.ndarray, foreign: np.ndarray) -> np.ndarray:
        """data in lower case, but what goes to the library."""
        upper = (data >= 0x41) & (data <= 0x5A)
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (kind[1:] == LETTER)
        return data | (upper & ~foreign).astype(np.uint8) << 5

    def _distinct(self, words: pa.StringArray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each word has, all of them in turn). foreign: which words go to the library."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]
        length = np.diff(offsets)
        foreign = foreign | (length > LONGEST)
        size = np.zeros(len(words), np.int64)
        rest = np.flatnonzero(foreign)
        given = self.whole(words.take(pa.array(rest)).to_pylist()) if len(rest) else []
        size[rest] = list(map(len, given))
        own, count = self.merges.words(data[np.repeat(~foreign, length)], length[~foreign])
        size[~foreign] = count
        if not len(rest):
            return size, own.astype(self.dtype)
        out = np.zeros(int(size.sum()), self.dtype)
        mine = np.repeat(~foreign, size)
        out[mine] = own
        out[~mine] = np.concatenate(given)
        return size, out

    def _ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, all of them in turn) of the texts that begin and end at `bounds`."""
        nothing = np.zeros(len(bounds) - 1, np.int64), np.zeros(0, self.dtype)
        if not len(data):
            return nothing
        kind, cut, foreign = self._cuts(data, bounds)
        if self.lowers:
            data = self._lowered(data, kind, foreign)
        begins = np.flatnonzero(cut)
        if self.kind == "plain":  # white space is taken out
            stays = (kind != SPACE) | foreign
            begins = begins[stays[begins]]
            if not len(begins):
                return nothing
            flags = foreign[begins]
            place = np.r_[0, np.cumsum(stays)]
            data, begins, bounds = data[stays], place[begins], place[bounds]
        else:
            flags = foreign[begins]
        ends = np.r_[begins, len(data)].astype(np.int32)
        coded = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        index = coded.indices.to_numpy()
        out_of = np.zeros(len(coded.dictionary), bool)
        out_of[index[flags]] = True
        size, ids = self._distinct(coded.dictionary, out_of)
        count = size[index]
        total = np.r_[0, np.cumsum(count)]
        at = np.repeat((np.cumsum(size) - size)[index] - total[:-1], count)
        at += np.arange(total[-1])
        return np.diff(total[np.searchsorted(begins, bounds)]), ids[at]

    def column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sizes, ids) of stretches of a column: how many ids each text of the stretch has, and all of them in
        turn. A null text has none. A stretch holds at least a text, and about WINDOW bytes; a longer text is
        handled by windows."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WINDOW, side="right")) - 1)
            part, bounds = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            if not self.kind:
                ids = self.whole(texts.slice(at, end - at).to_pylist())
                yield np.array(list(map(len, ids)), np.int64), np.concatenate(ids)
            elif len(part) > WINDOW and (self.kind == "plain" or not UNUSUAL_BYTES.search(part)):
                parts = [self._ids(w, np.array([0, len(w)])) for w in windows(part)]
                yield sum(s for s, _ in parts), np.concatenate([i for _, i in parts])
            else:
                yield self._ids(part, bounds)
            at = end

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian integers of self.width bytes."""
        for sizes, ids in self.column(pa.array(texts, pa.large_string())):
            raw, ends = ids.tobytes(), (self.width * np.cumsum(sizes)).tolist()
            yield from (raw[a:b] for a, b in zip([0, *ends], ends))  # noqa: B905

    def count(self, texts: Iterable[str]) -> Iterator[int]:
        """The number of ids of each text."""
        for sizes, _ in self.column(pa.array(texts, pa.large_string())):
            yield from sizes.tolist()


def cut_kind(spec: dict) -> str:
    """'spaced', 'plain' or '' (not to be cut), by the tokenizer's own description."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or []):
        return ""
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "spaced"
    steps = pre.get("pretokenizers") or [{}]
    harmless = {"NFC", "Lowercase", "Replace"}
    replaces = [n for n in (norm or {}).get("normalizers", []) if n["type"] == "Replace"]
    if (
        len(steps) > 1
        and steps[0].get("type") == "Split"
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert")
        and all(s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in steps[1:])
        and not re.search(r"\(\?", steps[0]["pattern"].get("Regex", "(?"))
        and {n["type"] for n in (norm or {}).get("normalizers", [])} <= harmless
        and all(r["pattern"] == {"Regex": r"\s+"} and r["content"] == " " for r in replaces)
    ):
        return "plain"
    return ""


def windows(data: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of a text that may be cut, in parts of about WINDOW that end where pieces end."""
    at = 0
    while len(data) - at > WINDOW:
        end = at + WINDOW
        while end < len(data):
            near = CLASS[data[end - 1 : end + 65_536]] == SPACE
            found = np.flatnonzero(near[1:] & ~near[:-1])
            if len(found):
                end += int(found[0])
                break
            end += 65_536
        end = min(end, len(data))
        yield data[at:end]
        at = end
    if at < len(data):
        yield data[at:]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
