"""Approximate maximum-inner-product search by score-aware (anisotropic) product quantisation.

The residual's part parallel to a vector changes its inner products with the queries that matter, those near
it; so it weighs more in the loss than the orthogonal part. A vector is cut into pairs of components, each
coded by 4 bits; a scan adds up table entries, and the best of it are ranked again by exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asterfold.llm import blocks
from asterfold.llm.shared import hash_sample, write_table

#: Vectors that the codebooks are fitted on (a sample by the hash of their ids); every row is coded.
SAMPLE = 20_000
WIDTH, CENTRES, THRESHOLD = 2, 16, 0.2
#: Vectors that are ranked exactly for each query, for each doubling of the table, and codes that meet a block of
#: queries at once.
RERANK, CODES = 50, 1 << 20


def weight(dim: int, threshold: float = THRESHOLD) -> float:
    """How much more the parallel residual counts, for queries of cosine `threshold` and more."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def split(x: np.ndarray) -> np.ndarray:
    """(rows, parts, WIDTH), filled up with zeros; an even number of parts, two to a byte."""
    parts = -(-x.shape[1] // (2 * WIDTH)) * 2
    return np.pad(x, ((0, 0), (0, parts * WIDTH - x.shape[1]))).reshape(len(x), parts, WIDTH)


class Quantiser:
    def __init__(self, sample: np.ndarray, rounds: int = 6):
        x = split(sample)
        n, parts, _ = x.shape
        self.eta = weight(sample.shape[1])
        rng = np.random.default_rng(0)
        pick = np.stack([rng.permutation(n)[np.arange(CENTRES) % n] for _ in range(parts)])
        self.centres = np.stack([x[pick[m], m] for m in range(parts)])  # (parts, CENTRES, WIDTH)
        for r in range(rounds):
            codes = self.codes(x, plain=r < rounds // 2)
            self._refit(x, codes, 0.0 if r < rounds // 2 else self.eta - 1)

    def _weights(self, x: np.ndarray) -> np.ndarray:
        return (self.eta - 1) / np.maximum((x**2).sum(axis=(1, 2)), 1e-30)

    def codes(self, x: np.ndarray, plain: bool = False, passes: int = 2) -> np.ndarray:
        """Codes of least loss, by coordinate descent over the parts, from the nearest centres on."""
        n, parts, _ = x.shape
        square = np.stack([((x[:, m, None] - self.centres[m]) ** 2).sum(axis=2) for m in range(parts)], axis=1)
        codes = square.argmin(axis=2)
        if plain:
            return codes
        along = np.stack([((x[:, m, None] - self.centres[m]) * x[:, m, None]).sum(axis=2) for m in range(parts)], axis=1)
        w, rows = self._weights(x), np.arange(n)
        total = along[rows[:, None], np.arange(parts), codes].sum(axis=1)
        for _ in range(passes):
            for m in range(parts):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (square[:, m] + w[:, None] * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[rows, m, codes[:, m]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray, extra: float) -> None:
        """The centres of least loss for these codes, part by part (a small linear system for each)."""
        n, parts, _ = x.shape
        w = self._weights(x) if extra else np.zeros(n)
        along = np.stack([((x[:, m] - self.centres[m][codes[:, m]]) * x[:, m]).sum(axis=1) for m in range(parts)], axis=1)
        total = along.sum(axis=1)
        for m in range(parts):
            part, rest = x[:, m], total - along[:, m]
            for c in range(CENTRES):
                at = codes[:, m] == c
                if at.any():
                    p, v = part[at], w[at]
                    left = at.sum() * np.eye(WIDTH) + (p * v[:, None]).T @ p
                    right = p.sum(axis=0) + (p * (v * (rest[at] + (p**2).sum(axis=1)))[:, None]).sum(axis=0)
                    self.centres[m][c] = np.linalg.solve(left, right)
            total = rest + ((part - self.centres[m][codes[:, m]]) * part).sum(axis=1)

    def pack(self, vectors: np.ndarray) -> np.ndarray:
        codes = self.codes(split(vectors)).astype(np.uint8)
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """(rows, queries): sums of 8-bit table entries, larger for larger inner products."""
        tables = np.einsum("qmw,mcw->mcq", split(queries), self.centres)
        low = tables.min(axis=1, keepdims=True)
        step = np.maximum((tables.max(axis=1, keepdims=True) - low).max(axis=0, keepdims=True), 1e-30) / 255
        tables = np.rint((tables - low) / step).astype(np.int16)
        out = np.zeros((len(packed), len(queries)), np.int16 if tables.shape[0] * 255 < 1 << 15 else np.int32)
        for j in range(packed.shape[1]):
            both = (tables[2 * j][:, None] + tables[2 * j + 1][None]).reshape(CENTRES * CENTRES, -1)
            out += both[packed[:, j]]
        return out


def scan_best(quantiser: Quantiser, queries: np.ndarray, packed: np.ndarray, keep: int, rows: int = 8_192, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(queries, keep): places of the largest sums and the sums, stretch by stretch of the codes; of equal sums
    those met first. Places are -1 where there are fewer codes."""
    places, sums = np.full((len(queries), keep), -1), np.full((len(queries), keep), -1)
    for q in range(0, len(queries), at_once):
        best_at, best = places[q : q + at_once], sums[q : q + at_once]
        for start in range(0, len(packed), rows):
            new = quantiser.scan(queries[q : q + at_once], packed[start : start + rows]).T.astype(np.int64)
            both = np.concatenate([best, new], axis=1)
            # The sum, and among equals the place.
            key = both * both.shape[1] + np.arange(both.shape[1])[::-1]
            top = np.argpartition(key, both.shape[1] - keep, axis=1)[:, both.shape[1] - keep :]
            top.sort(axis=1)
            at = np.concatenate([best_at, np.broadcast_to(np.arange(start, start + new.shape[1]), new.shape)], axis=1)
            best_at, best = np.take_along_axis(at, top, axis=1), np.take_along_axis(both, top, axis=1)
        places[q : q + at_once], sums[q : q + at_once] = best_at, best
    return places, sums


def fit(rows: DataFrame, dim: int) -> Quantiser:
    sample = hash_sample(rows, ["id"], SAMPLE).toPandas().sort_values("id")["vector"]
    return Quantiser(np.stack([np.pad(np.asarray(v, float), (0, dim - len(v))) for v in sample]))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """id (the smallest of a vector's), ids (its k + 1 smallest, ascending), vector: a row for each different
    vector. No more of a vector's ids can be among a query's k nearest, its own left out."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "vector")


def coded(stock: DataFrame, sent, dim: int, size: int, count: int) -> tuple[DataFrame, int]:
    """block, ids, codes: every vector's codes, one row for each block of about `size` vectors."""

    def code(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                codes = sent.value.pack(blocks.matrix(part.column(1), dim, float))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "codes"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": [table.column("id").to_numpy().tobytes()], "codes": [b"".join(table.column("codes").to_pylist())]})

    n = max(1, -(-count // size))
    dealt = stock.select("id", "vector").mapInArrow(code, "id long, codes binary").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInArrow(run, "block int, ids binary, codes binary"), n


def nearest(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for every id divisible by `every`.

    Every vector is coded once. The codes, packed, meet the queries; each query keeps its `rerank` largest sums
    over all blocks (RERANK for each doubling of the table, unless given), and only their vectors are fetched
    and ranked exactly. Copies of one vector are coded and
    ranked once, however many, and stand for their ids at the end.

    Scores are exact inner products in double precision of the original vectors; ties go to smaller ids; with
    fewer candidates all are returned; an empty table gives no rows. Vectors null, zero, empty or with null or
    non-finite components take no part, nor do null ids. An id stands for one vector (see blocks.usable), so
    that repeated rows count once; shorter vectors count as filled up with zeros; other columns are ignored,
    whatever their names.
    """
    spark = df.sparkSession
    rows, _ = write_table(blocks.usable(df, id_col, vector_col, zero=False), "vectors")
    count, asked, dim = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.coalesce(F.max(F.size("vector")), F.lit(0))).head()
    sent = spark.sparkContext.broadcast(fit(rows, dim) if count else None)
    kind = blocks.kind_of(rows, "vector")
    stock, _ = write_table(distinct(rows, k), "distinct")
    codes = coded(stock, sent, dim, CODES, count)
    queries = rows.where(F.col("id") % every == 0)
    asking = blocks.packed(queries, asked, blocks.query_size(rows, asked), dim)
    # A query's own vector may be among the best, and is left out only once its ids are known.
    keep = max(rerank or RERANK * count.bit_length(), k) + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, ids = blocks.read(left, "q_ids", np.int64), blocks.read(right, "ids", np.int64)
        packed = blocks.read(right, "codes", np.uint8).reshape(len(ids), -1)
        places, sums = scan_best(sent.value, blocks.read(left, "q_vectors", kind, dim), packed, min(keep, len(ids)))
        return pa.table({"query_id": np.repeat(q_ids, places.shape[1]), "vec_id": ids[places.ravel()], "score": sums.ravel()})

    found = blocks.ranked(blocks.met(*asking, *codes, run, "query_id long, vec_id long, score long", length=1), keep)
    pairs, _ = write_table(found.select("query_id", F.col("vec_id").alias("id")), "pairs")

    def exact(batches):
        for batch in batches:
            left, right = (blocks.matrix(batch.column(i), dim, float) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", left, right))], ["query_id", "ids", "score"])

    # Shuffled at every size: pairs grow with the queries, vectors with the table.
    full = pairs.join(stock.select("id", "ids", "vector").hint("shuffle_merge"), "id")
    full = full.join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q_vector")).hint("shuffle_merge"), "query_id")
    scored = full.select("query_id", "ids", "vector", "q_vector").mapInArrow(exact, "query_id long, ids array<long>, score double")
    return blocks.ranked(scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id"), k)
