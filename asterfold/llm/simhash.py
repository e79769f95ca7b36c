"""SimHash fingerprints and near-duplicate groups found by anchor-point covering.

A covering code of radius R has a code word within R bits of every value. If two values differ in at most t
bits, every code word within R of the one is within R + t of the other. So each value is sent to all code
words ("anchors") within R + t, and compared there with the values that have the anchor within R.

A 64-bit fingerprint is cut into segments; of two fingerprints that differ in at most 4 bits, some segment differs
in at most t. The code of a segment is a Hamming code on its low bits (radius 1, every value at most one bit from
exactly one code word) with all values of its other bits: R = 1, anchors within R + t. No pair is missed, whatever
the layout; it is chosen by the number of fingerprints, so that an anchor has few of them: three segments, t = 1,
codes on 15 bits (43 anchors for each fingerprint, of 2^19), or for more of them two segments, t = 2, codes on 31
bits (some 340, of 2^28).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from asterfold.llm.components import components
from asterfold.llm.shared import shuffle_width, write_table

SHINGLE, SEED, DISTANCE = 4, 42, 4


class Layout(NamedTuple):
    """segments: (lowest bit, bits); checked: bits of the Hamming code; near: bits in which some segment differs."""

    segments: tuple[tuple[int, int], ...]
    checked: int
    near: int


FEW, MANY = Layout(((0, 21), (21, 21), (42, 22)), 15, 1), Layout(((0, 32), (32, 32)), 31, 2)
#: Distinct fingerprints from which on MANY costs less than FEW.
LARGE = 1 << 26
#: Rows of an anchor, and of these home rows, that are compared at once; an anchor with more is split by both.
ANCHOR_ROWS, HOME_ROWS = 1 << 18, 1 << 14
PAIRS = 1 << 22


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint; 0 for a null text and one without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space 09-0D and 20
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    first, last = (ends - size)[: len(words) - k + 1], ends[k - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), 65_536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + 65_536].tolist(), last[at : at + 65_536].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a signed long) for every row."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


@lru_cache(maxsize=8)
def flips_of(bits: int, checked: int, reach: int) -> list[np.ndarray]:
    """For each syndrome of the Hamming part: the flips of at most `reach` bits that lead to a code word, the
    nearest code word's (at most one flip, in the Hamming part) first."""
    spot = [i + 1 if i < checked else 0 for i in range(bits)]  # what a bit adds to the syndrome
    found: list[list[int]] = [[] for _ in range(checked + 1)]
    for weight in range(reach + 1):
        for chosen in combinations(range(bits), weight):
            s = 0
            for i in chosen:
                s ^= spot[i]
            found[s].append(sum(1 << i for i in chosen))
    for s, masks in enumerate(found):
        home = 0 if s == 0 else 1 << (s - 1)
        masks.remove(home)
        masks.insert(0, home)
    return [np.array(m, np.int64) for m in found]


def anchors(fps: np.ndarray, layout: Layout = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, home) of every anchor within R + t bits of each fingerprint's segments; home: within R."""
    rows, keys, homes = [], [], []
    for number, (low, bits) in enumerate(layout.segments):
        value = (fps >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)
        syndrome = np.zeros(len(fps), np.int64)
        for i in range(layout.checked):
            syndrome ^= (value >> i & 1) * (i + 1)
        for s, flips in enumerate(flips_of(bits, layout.checked, 1 + layout.near)):
            at = np.flatnonzero(syndrome == s)
            rows.append(np.repeat(at, len(flips)))
            keys.append(((value[at][:, None] ^ flips) | number << 32).ravel())
            homes.append(np.tile(np.arange(len(flips)) == 0, len(at)))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def stars(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, centre) that connect, key by key, all that lie within `distance` of a home row.

    Rows are sorted by key. Small groups are compared at one go; in a large one every row that was reached
    leaves the rows still to compare, so that a group of near copies costs few comparisons. At most one link
    for each row comes out.
    """
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[begin, len(keys)])
    label = np.arange(len(keys))
    group = np.repeat(np.arange(len(begin)), size)
    work = np.bincount(group[home], minlength=len(begin)) * size
    small = work <= PAIRS // 16
    seeds = np.flatnonzero(home & small[group])
    pairs_a, pairs_b = [], []
    cost = np.cumsum(size[group[seeds]])
    for part in np.split(seeds, np.searchsorted(cost, np.arange(PAIRS, cost[-1] if len(cost) else 0, PAIRS))):
        n = size[group[part]]
        a = np.repeat(part, n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[group[part]], n)
        near = (np.bitwise_count(fps[a] ^ fps[b]) <= distance) & (a != b)
        pairs_a.append(a[near])
        pairs_b.append(b[near])
    if pairs_a:
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        while len(a):
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (before == label).all():
                break
    for g in np.flatnonzero(~small):
        rest = np.arange(begin[g], begin[g] + size[g])
        values = fps[rest]
        for seed in rest[home[rest]]:
            if label[seed] != seed or not len(rest):
                continue
            open_rows = [seed]
            keep = rest != seed
            rest, values = rest[keep], values[keep]
            while open_rows and len(rest):
                near = np.bitwise_count(values ^ fps[open_rows.pop()]) <= distance
                if near.any():
                    reached = rest[near]
                    label[reached] = seed
                    open_rows.extend(reached)
                    rest, values = rest[~near], values[~near]
    member = np.flatnonzero(label != np.arange(len(keys)))
    return member, label[member]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect exactly what at most `distance`
    differing bits connect, by stars at each anchor."""
    if not 0 <= distance <= 4:
        raise ValueError("the segments are laid out for a distance of at most 4")
    spark = distinct.sparkSession
    count = distinct.count()
    layout = MANY if count >= LARGE else FEW

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 8192 // layout.near**2):
                part = fps[at : at + 8192 // layout.near**2]
                rows, keys, home = anchors(part, layout)
                yield pa.RecordBatch.from_arrays([pa.array(keys << 1 | home), pa.array(part[rows].view(np.int64))], ["k", "fp"])

    dealt = distinct.select("fp").mapInArrow(deal, "k long, fp long").withColumn("chunk", F.lit(0))
    if count > HOME_ROWS:  # else no anchor can have so many
        # A busy anchor's rows are cut in parts, and its home rows too; each part meets each: every comparison is made.
        key, home = F.shiftright("k", 1).alias("key"), F.expr("k & 1")
        sizes = dealt.groupBy(key).agg(F.count("*").alias("rows"), F.sum(home).alias("homes"))
        busy = sizes.where((F.col("rows") > ANCHOR_ROWS) | (F.col("homes") > HOME_ROWS))
        parts = busy.select("key", F.ceil(F.col("rows") / ANCHOR_ROWS).cast("int").alias("parts"), F.ceil(F.col("homes") / HOME_ROWS).cast("int").alias("home_parts"))
        parts, _ = write_table(parts, "parts")
        split = not parts.isEmpty()
    if count > HOME_ROWS and split:
        one = F.expr("cast(pmod(xxhash64(fp), parts) as int)")
        mine = F.expr("cast(pmod(xxhash64(fp, 1), home_parts) as int)")
        as_row = F.transform(F.sequence(F.lit(0), F.col("home_parts") - 1), lambda i: F.struct((i * F.col("parts") + one).alias("chunk"), F.lit(False).alias("home")))
        as_home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct((mine * F.col("parts") + j).alias("chunk"), F.lit(True).alias("home")))
        places = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("chunk"), (home == 1).alias("home")))).when(home == 1, F.concat(as_home, as_row)).otherwise(as_row)
        met = dealt.drop("chunk").withColumn("key", F.shiftright("k", 1)).join(parts, "key", "left").select("key", "fp", F.explode(places).alias("place"))
        dealt = met.select(F.expr("key * 2 + cast(place.home as long)").alias("k"), "fp", F.col("place.chunk").alias("chunk"))

    def compare(batches):
        def found(keys, fps, home):
            member, centre = stars(keys, fps, home, distance)
            return pa.RecordBatch.from_arrays([pa.array(fps[member].view(np.int64)), pa.array(fps[centre].view(np.int64))], ["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, chunk = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            group = np.stack([k >> 1, chunk])
            now = (group, batch.column(1).to_numpy().view(np.uint64), (k & 1).astype(bool))
            held.append(now)
            if (group[:, 0] == group[:, -1]).all() and (held[0][0][:, 0] == group[:, 0]).all():
                continue
            yield found(*closed(held, last=False))
        if held:
            yield found(*closed(held, last=True))

    def closed(held, last):
        """Groups as numbers, fingerprints and homes of all groups in turn that are complete; the rest stays."""
        group, fps, home = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
        begin = np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0)]
        cut = len(fps) if last else int(np.flatnonzero(begin)[-1])
        held[:] = [] if last else [(group[:, cut:], fps[cut:], home[cut:])]
        return np.cumsum(begin)[:cut], fps[:cut], home[:cut]

    met = dealt.repartition(shuffle_width(spark), F.expr("shiftright(k, 1)"), "chunk").sortWithinPartitions(F.expr("shiftright(k, 1)"), "chunk")
    return met.mapInArrow(compare, "a long, b long")


def _linked(df: DataFrame, id_col: str, text_col: str, distance: int, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, fp) of every row; (fp, first: its smallest id) of distinct fingerprints; (node, root) of linked ones."""
    table, _ = write_table(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct, _ = write_table(table.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    return table, distinct, components(links(distinct, distance))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id for every row.

    component_id is the smallest id reachable by links of at most `distance` differing bits. Equal
    fingerprints meet in one row before anything is compared, so that copies, however many, cost nothing.
    Null and empty texts, and those without words, have fingerprint zero and link like any other; a text of any
    length counts with all its shingles; a bit that is set in just half of the hashes is 0. Repeated rows stay.
    Null ids never name a component unless it has no other id; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    table, distinct, roots = _linked(df, id_col, text_col, distance, shingle)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root").select("fp", "least")
    of, _ = write_table(distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named")
    return table.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _printed(df: DataFrame, text_col: str) -> DataFrame:
    """df with _print, each row's fingerprint."""
    text_at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(t) for t in part.column(text_at).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps.view(np.int64))], [*part.schema.names, "_print"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("_print", LongType())]))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near duplicates, whatever its ids are; columns as they are.

    It is a row of the group's smallest id (null only if there is no other) and, of several such fingerprints,
    the smallest. Only where ids are null or repeated are rows told apart by their fingerprints too, which are
    then made a second time.
    """
    table, distinct, roots = _linked(df, id_col, text_col, distance)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias("row"))
    keep, _ = write_table(rooted.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.first").alias("_kept"), F.col("row.fp").alias("_fp")), "keep")
    # Shuffled at every size: what is kept grows with the corpus.
    if table.groupBy("id").count().where("id is null or count > 1").isEmpty():
        return df.join(keep.drop("_fp").hint("shuffle_hash"), df[id_col] == keep["_kept"]).drop("_kept")
    same = lambda a, b: a["id"].eqNullSafe(b["_kept"]) & (a["fp"] == b["_fp"])
    rows, _ = write_table(table.join(keep.hint("shuffle_hash"), same(table, keep)).groupBy("_kept", "_fp").agg(F.count("*").alias("_rows")), "rows")
    printed = _printed(df, text_col)
    joined = printed.join(rows.hint("shuffle_hash"), printed[id_col].eqNullSafe(rows["_kept"]) & (printed["_print"] == rows["_fp"]))
    single = joined.where("_rows = 1").select(*df.columns)
    if rows.where("_rows > 1").isEmpty():
        return single
    return single.unionByName(joined.where("_rows > 1").dropDuplicates(["_kept", "_fp"]).select(*df.columns))
