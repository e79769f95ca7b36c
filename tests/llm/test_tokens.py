"""Token operators against the libraries, by brute force."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from asterfold.llm import huffman, packing, pieces, token_counts, tokens

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
EDGES = [
    "", " ", "   ", "\n\n\n a", "a  b<|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>", " lead", "trail  ", "it's 'll 123 ４５６ ñä ̈z", "Ωσς ΣΑΣ İ", "a\tb\r\nc   d", "é" * 50,
    "日本語 テキスト  😀😀 !", "a\xa0 b　c", "a\x1c b", "x" * 5000, "ab " * 3000, "\x00 z", "no-break  line", "<|startoftext|> a", "!!!", "​ x",
]


def fuzz(n=300, seed=3, alphabet="abcde  \n\t.,'’é日😀0\xa0̈<|>T"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ROWS = [(i, t) for i, t in enumerate([*EDGES, None, "again", "again"])] + [(3, "a second row of one id"), (None, "no id")]
SCHEMA = "doc_id long, text string, id string, part int, bucket string, ids string, n_tokens int"


def documents(spark, rows=ROWS):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 7, "b", "y", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_are_exact(path):
    library, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = EDGES + fuzz() + fuzz(2000, 4, "strevmldSTREVMLD''  \n1éÉ×.") + fuzz(300, 5, "'s <|endoftext|>ENDOF") + ["a<|endoftext|>'s <|ENDOFTEXT|>", "'", "x '", "'s", "It'S 'LL", "Größe ÀÉÎÕÜ ÿþ ÷×ß", "don''t  '\n'll"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # without and with what was remembered
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want
        assert list(enc.count(texts)) == list(map(len, want))


def test_small_windows(monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", 40)
    enc, library = tokens.Encoder(BYTE), Tokenizer.from_file(BYTE)
    texts = fuzz(100) + ["word " * 100]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("chunk,overlap", [(40, 2), (64, 16), (300, 8)])
def test_splicing(path, chunk, overlap):
    library, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    for t in [*EDGES, *fuzz(40), "word, and more.\n" * 40, "solid" * 200, "a" * 700 + " b c d " * 50 + "\xa0" * 99 + "<|endoftext|> " * 30]:
        if t:
            assert [i for part in token_counts.splice(enc, t, chunk, overlap) for i in part] == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_splicing_without_spaces(path):
    rng = random.Random(1)
    library, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = ["abc<|endoftext|>'s", "aB1'é-", "日本語です。テキスト、", letters + letters.upper() + "0123456789+/", letters, "<|endoftext|>"]
    for alphabet in kinds:
        for n in (30, 100, 900):
            t = "".join(rng.choice([alphabet, *alphabet]) for _ in range(n))
            for chunk, overlap in ((20, 2), (64, 5), (200, 30)):
                assert [i for part in token_counts.splice(enc, t, chunk, overlap) for i in part] == library.encode(t, add_special_tokens=False).ids
    for alphabet in (kinds[2], kinds[3]):  # a million characters: linear, not quadratic
        t = "".join(rng.choices(alphabet, k=1_000_000))
        at = time.perf_counter()
        n = token_counts.count_long(enc, t, token_counts.CHUNK, token_counts.OVERLAP)
        took = time.perf_counter() - at
        at = time.perf_counter()
        assert n == len(library.encode(t, add_special_tokens=False).ids)
        assert took < 5 + 4 * (time.perf_counter() - at)
    run = "".join(rng.choices(letters, k=200_000))  # one word: nowhere to splice
    assert token_counts.count_long(enc, run, token_counts.CHUNK, token_counts.OVERLAP) == len(library.encode(run, add_special_tokens=False).ids)


def test_token_counts(spark):
    library = Tokenizer.from_file(BYTE)
    for chunk in (token_counts.CHUNK, 100):
        rows = token_counts.token_counts(documents(spark), BYTE, limit=100, chunk=chunk, overlap=10).collect()
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows), key=str)
        want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in ROWS]
        assert got == sorted(want, key=str)
    assert token_counts.token_counts(documents(spark, []), BYTE).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(documents(spark), PIECE)


@pytest.mark.parametrize("length", [4096, 7])
def test_packing(spark, length):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack(documents(spark), WORD, length=length, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    place = (rows.sequence_id * length + rows.offset).tolist()
    assert place == (np.cumsum(rows.length) - rows.length).tolist()
    assert (rows.offset + rows.length <= length).all()
    want = sorted((str(i), tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in ROWS)
    got, held = [], []
    for r in rows.itertuples():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert crc(ids) == r.ids_crc32 and len(ids) == r.length and r.start == len(held)
        held += ids
        if len(held) == r.doc_tokens:
            got.append(("None" if r.doc_id != r.doc_id else str(int(r.doc_id)), tuple(held)))
            held = []
    assert sorted(got) == want and not held
    assert packing.pack(documents(spark, []), WORD).count() == 0


def test_code_lengths_are_optimal():
    rng = np.random.default_rng(0)
    for n, top in ((1, 3), (2, 2), (5, 3), (40, 6), (300, 16)):
        counts = np.zeros(n + 3, np.int64)
        counts[:n] = np.maximum(1, rng.pareto(0.6, n) * 3).astype(np.int64)
        lengths = huffman.code_lengths(counts, top).astype(int)
        assert (lengths[counts == 0] == 0).all() and lengths.max() <= top
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
        if n <= 5:  # against every assignment of lengths
            best = min(sum(c * x for c, x in zip(counts, ls)) for ls in np.ndindex(*[top + 1] * n) if all(ls) and sum(2.0**-x for x in ls) <= 1)
            assert (counts * lengths).sum() == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


@pytest.mark.parametrize("block,step", [(64, 8), (100, 128), (1 << 16, 128)])
def test_blocks_decode(block, step):
    rng = np.random.default_rng(1)
    counts = np.zeros(5000, np.int64)
    ids = (rng.pareto(0.7, 5000) * 2).astype(np.int64) % 5000
    np.add.at(counts, ids, 1)
    book = huffman.Codebook(huffman.code_lengths(counts))
    for n in (0, 1, 7, 8, 64, 65, 127, 5000):
        data = book.encode(ids[:n], block, step)
        assert book.decode(data).tolist() == ids[:n].tolist()
        for k in range(-(-n // block)):  # each block alone
            assert book.decode_block(data, k).tolist() == ids[:n][k * block : (k + 1) * block].tolist()
    with pytest.raises(ValueError):
        book.encode(np.flatnonzero(counts == 0)[:1])


@pytest.mark.parametrize("record", [huffman.RECORD_IDS, 50])
def test_token_files(spark, monkeypatch, record):
    monkeypatch.setattr(huffman, "RECORD_IDS", record)
    monkeypatch.setattr(huffman, "id_bounds", lambda df, column: [2, 9, 15])
    library = Tokenizer.from_file(BYTE)
    rows = huffman.round_trip(documents(spark), BYTE).toPandas().sort_values("start")
    want = sorted(((-1 if i is None else i), np.array(ids := [*library.encode(t or "", add_special_tokens=False).ids, 0], "<u2").tobytes(), ids) for i, t in ROWS)
    assert [(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows.itertuples()] == [(i, len(ids), crc(ids)) for i, _, ids in want]
    assert rows.start.tolist() == (np.cumsum(rows.n_tokens) - rows.n_tokens).tolist()
    assert huffman.round_trip(documents(spark, []), BYTE).count() == 0


def test_token_files_ascend(spark, tmp_path):
    """Part files, in the order of their names, and records in them hold ascending ids; a hot id is split."""
    from pyspark.sql import functions as F

    rows = spark.range(12_000).select(F.when(F.col("id") % 3 == 0, 7_000).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    huffman.write(rows, BYTE, f"file://{tmp_path}/set")
    records = spark.read.parquet(f"file://{tmp_path}/set/records").select("bucket", "start", "ids", F.col("_metadata.file_name").alias("file")).toPandas()
    records = records.sort_values("start")
    assert records.file.tolist() == sorted(records.file) and records.file.nunique() > 2
    flat = np.concatenate(records.ids.tolist())
    assert (np.diff(flat) >= 0).all() and len(flat) == 12_000
    assert records[[7_000 in x for x in records.ids]].bucket.nunique() > 1


def test_hot_keys_fill_several_ranges():
    cuts = np.array([3, 5, 5, 5, 9])
    keys, salt = np.array([1, 3, 4, 5, 5, 5, 5, 6, 9, 10]), np.array([0, 1, 2, 0, 1, 2, 3, 7, 8, 9])
    assert huffman.bucket_of(keys, cuts, salt).tolist() == [0, 1, 1, 2, 3, 4, 2, 4, 5, 5]


def test_sentencepiece(spark):
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.Pieces(PIECE)
    rng = random.Random(8)
    solid = ["".join(rng.choices(a, k=k)) for a in ("日本語です。テキスト", "abcXYZ019+/=", "aé日😀\x00b") for k in (60, 200, 5000)]
    texts = [*EDGES, *fuzz(1500, 5), *solid, "<s> </s> <unk> <0x0A>", "▁", "a▁b", " " * 70 + "x", "ab" * 500 + " c"]
    raws = list(own.encode(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in raws] == model.encode(texts)
    assert [own.decode(x) for x in raws] == [model.decode(np.frombuffer(x, "<u4").tolist()) for x in raws]
    for ids in ([0], [1, 2, 5], [200, 201], [259, 5, 1000], []):
        assert own.decode(np.array(ids, "<u4").tobytes()) == model.decode(ids)
    rows = pieces.round_trip(documents(spark), PIECE).collect()
    assert all(r["same"] for r in rows) and len(rows) == len(ROWS)
    assert sorted(r["ids_crc32"] for r in rows) == sorted(crc(model.encode(t or "")) for _, t in ROWS)
    again = pieces.decode(pieces.encode(documents(spark), PIECE), PIECE).collect()
    assert sorted(r["text"] for r in again) == sorted(t or "" for _, t in ROWS)
    assert pieces.round_trip(documents(spark, []), PIECE).count() == 0


def test_sentencepiece_matches_words_once(monkeypatch):
    """What differs only in marks that no piece joins to letters is cut from them, and matched once."""
    own, seen = pieces.Pieces(PIECE), []
    relax = own.relax
    monkeypatch.setattr(own, "relax", lambda chunks: seen.extend(chunks) or relax(chunks))
    words, marks = ["house", "Gruß", "ciudad", "nation", "über"], [".", ",", "!!", "$$$", "&&&", ".\nAnd", ".\nEt"]
    text = " ".join(w + m for w in words for m in marks)
    (raw,) = own.encode([text])
    assert sum(map(len, seen)) <= sum(len(w) + 1 for w in words) + sum(map(len, marks))
    assert own.decode(raw) == text


@pytest.mark.parametrize("memo", [0, 20, 1000])
def test_sentencepiece_small_windows(monkeypatch, memo):
    import sentencepiece

    for name, value in (("WINDOW", 60), ("BATCH", 30), ("MEMO", memo), ("LONG", 5)):
        monkeypatch.setattr(pieces, name, value)
    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.Pieces(PIECE)
    texts = [*fuzz(40, 6), "", "", *EDGES[:14], *fuzz(40, 7, "the house  of nations,.é日▁")]
    for _ in range(2):
        raws = list(own.encode(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in raws] == model.encode(texts)
        assert len(own.memo) <= memo
    assert list(own.decode_all(raws)) == [model.decode(np.frombuffer(x, "<u4").tolist()) for x in raws]
