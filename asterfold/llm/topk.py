"""Exact top-k by integer inner product, with no-random-access aggregation over sorted lists.

In a block of candidates every component is a list of the candidates, sorted by their value. What a candidate
has in a list, times the query's component, is its part of the score; lists are read from the end of large
parts on, entry by entry and never at a candidate's own place.

For a query, the gap of a list is what separates the last part read from the least part of all. The lists are
read in rounds, in each so far that all gaps are at most a common level: lists that matter little to a query are
read late or never. A candidate's lower bound is what was read of it, and the least part of each other list; its
upper bound adds the level for each list it hasn't been met in. Both need nothing but sums and counts over the
entries that were newly read. A query stops when all but a few candidates have upper bounds under the k-th
largest lower bound; the final scores of those few are resolved.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterfold.llm import blocks
from asterfold.llm.shared import write_table

SCALE = 64
#: Levels of the rounds, as shares of the first gap. The schedule changes what is read, never what is found.
LEVELS = (0.6, 0.42, 0.34, 0.28, 0.23, 0.18, 0.13, 0.07, 0.0)
#: A query's remaining candidates are resolved when they are this share of the block.
FEW = 1 / 5
LONG = 1 << 63
#: Places of a list at which reading may stop.
STOPS = 128
#: Sums of parts under this and counts of lists are added up in one number, exactly.
TALLY = 2.0**42


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * vectors), -np.finfo(float).max, np.finfo(float).max)


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, first: int = 0):
        """ids ascending; v: whole numbers, as doubles; first: the round to begin with, one before that in which the
        last query stopped."""
        self.ids, self.v, self.first = ids, v, first
        columns = np.ascontiguousarray(v.T)
        self.order = np.argsort(columns, axis=1, kind="stable")
        self.values = np.take_along_axis(columns, self.order, axis=1)
        self.most = np.abs(v).max(axis=0, initial=0)

        #: Places at which reading may stop, and the values there, ascending; beyond the ends no value.
        self.stops = np.unique(np.linspace(0, len(v), min(len(v), STOPS) + 1).astype(np.int64))
        self.at_stops = self.values[:, np.minimum(self.stops, max(0, len(v) - 1))] if len(v) else np.zeros((v.shape[1], 1))

    def best(self, q: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, list[int], int]:
        """(candidates, scores, entries read) of the k largest scores that are `least` or more, ties to smaller
        ids, and perhaps others; own: the query's own place in the block, or -1."""
        n, use = len(self.ids), np.flatnonzero(q)
        weight = q[use]
        with np.errstate(over="ignore"):
            largest = float(np.abs(weight) @ self.most[use]) if len(use) else 0.0
        exact = largest < 2.0**53  # all sums are then exact in double precision
        slack = 0.0 if exact else 2 * len(use) * 2.0**-50 * largest
        alive = np.arange(n)
        alive = alive[alive != own]
        entries = 0
        if len(use) and np.isfinite(slack) and len(alive) > k:
            alive, entries = self._read(weight, use, alive, k, slack, least)
        entries += len(alive) * len(use)
        if exact:
            scores = ((self.v[alive] if len(use) == self.v.shape[1] else self.v[np.ix_(alive, use)]) @ weight).astype(np.int64)
            order = np.lexsort((alive, -scores))[:k]
            return alive[order], scores[order].tolist(), entries
        full = [min(LONG - 1, max(-LONG, sum(int(a) * int(b) for a, b in zip(row, weight, strict=True)))) for row in self.v[np.ix_(alive, use)]]
        order = sorted(range(len(alive)), key=lambda i: (-full[i], alive[i]))[:k]
        return alive[order], [full[i] for i in order], entries

    def _depths(self, use: np.ndarray, up: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """How far each list is to be read, at one of the stops, that nothing unread is beyond its edge."""
        n = len(self.ids)
        under = (self.at_stops[use, :-1] < edge[:, None]).sum(axis=1)  # stops whose value is under the edge
        not_over = (self.at_stops[use, :-1] <= edge[:, None]).sum(axis=1)
        return np.where(up, n - self.stops[np.maximum(0, under - 1)], self.stops[not_over])

    def _read(self, weight: np.ndarray, use: np.ndarray, alive: np.ndarray, k: int, slack: float, least: float) -> tuple[np.ndarray, int]:
        """(the candidates that may be among the k best, entries read)."""
        n, up = len(self.ids), weight > 0
        far = weight * np.where(up, self.values[use, 0], self.values[use, -1])
        gap = weight * np.where(up, self.values[use, -1], self.values[use, 0]) - far
        tally = not slack and gap.sum() < TALLY and len(use) < 1 << 10
        sums, met, floor, add = np.zeros(n), np.zeros(n), far.sum(), TALLY - far if tally else -far
        depth, entries = np.zeros(len(use), np.int64), 0
        for number in range(self.first, len(LEVELS)):
            level = LEVELS[number] * gap.max()
            read = gap > level
            to = np.where(read, np.maximum(depth, self._depths(use, up, (far + level) / weight) if level else n), depth)
            for j in np.flatnonzero(to > depth).tolist():
                seen, stop = int(depth[j]), int(to[j])
                span = slice(n - stop, n - seen) if up[j] else slice(seen, stop)
                part = self.values[use[j], span] * weight[j]
                part += add[j]
                at = self.order[use[j], span]
                np.add.at(sums, at, part)
                if not tally:
                    np.add.at(met, at, 1)
                entries += stop - seen
            depth = to
            if tally:
                met = np.floor(sums / TALLY)
            bound = (sums - met * TALLY if tally else sums)[alive] + floor
            if len(bound) >= k:
                least = max(least, float(np.partition(bound, len(bound) - k)[len(bound) - k]))
            upper = bound + gap[~read].sum() + level * (1 + 1e-9) * (read.sum() - met[alive])
            # Scores beyond 64 bits are equal, whatever they exceed them by.
            alive = alive[upper >= (min(least, 2.0**62.99) if least > -(2.0**62.99) else -np.inf) - slack]
            if len(alive) <= FEW * n:
                break
        self.first = max(0, number - 1)
        return alive, entries


def meet(q_ids: np.ndarray, queries: np.ndarray, stock: Iterable[tuple[np.ndarray, np.ndarray]], k: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query index, id, score) of each query's k best in some blocks, each (ids ascending, vectors), and the share
    of all entries that was read. From block to block a query needs no less than its k-th score so far."""
    q, entries, size, first = whole(queries, scale), 0, 0, 0
    best: list[list[tuple[int, int]]] = [[] for _ in q]  # (-score, id)
    for ids, vectors in stock:
        lists = Lists(ids, whole(vectors, scale), first)
        size += vectors.size
        places = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)
        own = np.where(ids[places] == q_ids, places, -1).tolist()
        for i, row in enumerate(q):
            least = float(-best[i][-1][0]) if len(best[i]) == k else -np.inf
            some, scores, count = lists.best(row, own[i], k, least)
            entries, first = entries + count, lists.first
            best[i] = sorted(best[i] + [(-s, x) for s, x in zip(scores, ids[some].tolist(), strict=True)])[:k]
    rows = np.repeat(np.arange(len(q)), [len(b) for b in best])
    found = np.array([x for b in best for _, x in b], np.int64)
    return rows, found, np.array([-s for b in best for s, _ in b], np.int64), entries / max(1, len(q) * size)


def top_scores(df: DataFrame, every: int = 20, k: int = 20, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * x) vectors.

    Exact. Queries are the ids divisible by `every`, candidates all others' rows; ties go to smaller ids; with
    fewer candidates all are returned; an empty table gives no rows. Vectors null, empty or with null or
    non-finite components take no part, nor do null ids. An id stands for one vector (see blocks.usable), so
    that repeated rows count once; shorter vectors count as filled up with zeros; other columns are ignored,
    whatever their names. Scores beyond 64 bits are given as the largest or smallest 64-bit number.

    A block of queries meets a run of candidate blocks in one task, one block after the other. Where bounds don't
    help, as with many components of equal weight, most of each list is read.
    """
    rows, _ = write_table(blocks.usable(df, id_col, vector_col, zero=True), "vectors")
    count, asked, dim = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.coalesce(F.max(F.size("vector")), F.lit(0))).head()
    kind = blocks.kind_of(rows, "vector")
    stock = blocks.packed(rows, count, blocks.CANDIDATES, dim)
    asking = blocks.packed(rows.where(F.col("id") % every == 0), asked, blocks.query_size(rows, asked), dim)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids = blocks.read(left, "q_ids", np.int64)
        stock = ((blocks.read(right, "ids", np.int64, row=i), blocks.read(right, "vectors", kind, dim, row=i)) for i in range(right.num_rows))
        at, found, scores, _ = meet(q_ids, blocks.read(left, "q_vectors", kind, dim), stock, k, scale)
        return pa.table({"query_id": q_ids[at], "vec_id": found, "score": scores})

    return blocks.ranked(blocks.met(*asking, *stock, run, "query_id long, vec_id long, score long"), k)
