"""Near duplicates, nearest neighbours and top scores against brute force."""

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from asterfold.llm import ann, blocks, components, simhash, topk


def plain_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, ids, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(fps)):
        out.setdefault(find(i), []).append(i)
    return {i: min((ids[j] for j in members if ids[j] is not None), default=None) for members in out.values() for i in members}


TEXTS = ["", None, "One", "one", "ÀÉ ı one two three", "a b c", "a  b\tc d\x0be\n" * 30, "A b c D e " * 30, "x" * 40_000, "w " * 9_000, "zero\x1cone two"]


def test_fingerprints(spark):
    words = [" ".join(np.random.default_rng(s).choice(["ab", "Cd", "ef", "gh", "ij"], s % 40)) for s in range(60)]
    texts = TEXTS + words
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    # The hash is the one that Spark's own function computes.
    df = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s"))
    assert df.head()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b c d", 42)


@pytest.mark.parametrize("large", [simhash.LARGE, 1])
@pytest.mark.parametrize("anchor_rows,home_rows,pairs", [(simhash.ANCHOR_ROWS, simhash.HOME_ROWS, simhash.PAIRS), (30, 7, 64)])
def test_links_connect_what_is_near(spark, monkeypatch, anchor_rows, home_rows, pairs, large):
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", anchor_rows)
    monkeypatch.setattr(simhash, "HOME_ROWS", home_rows)
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 63, 120)]

    def flipped(x, k):
        for b in rng.choice(64, k, replace=False):
            x ^= 1 << int(b)
        return x

    fps = sorted({*base, *(flipped(x, int(rng.integers(1, 8))) for x in base for _ in range(2)), *(flipped(base[0], int(rng.integers(0, 5))) for _ in range(200)), 0, 15, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    root = {r["node"]: r["root"] for r in found}
    want = groups(fps, signed)
    assert {x: root.get(x, x) for x in signed} == {x: want[i] for i, x in enumerate(signed)}


def test_near_duplicates(spark):
    long_text = " ".join(f"w{i % 97}x{i}" for i in range(400))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, long_text), (51, long_text + " more"), (52, long_text), (52, long_text), (None, long_text), (60, "quite another text of some words")]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, id string, fp int").repartition(3)
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    want = groups(fps, [i for i, _ in rows])
    assert got == sorted((str(i), f"{fps[k]:016x}", want[k]) for k, (i, _) in enumerate(rows))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    empty = df.where("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_one_of_each_group_whatever_its_ids(spark):
    """Null and repeated ids name no group: each group keeps one row."""
    words = lambda k: " ".join(f"v{k}x{i}" for i in range(300))
    lone = [(None, words(1)), (None, words(2)), (7, words(3)), (7, words(4))]  # four texts, two ids
    copies = [(None, words(5)), (None, words(5)), (9, words(6)), (None, words(6)), (7, words(6)), (8, words(8)), (8, words(8))]
    for rows in (lone + copies, [(None, words(2)), (9, words(6)), (None, words(6))], [(None, words(1))] * 3):
        df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, fp string, id int").repartition(3)
        kept = simhash.one_of_each(df)
        assert kept.columns == df.columns
        got = sorted((r["text"], str(r["doc_id"])) for r in kept.collect())
        least = {t: min((i is None, i or 0, str(i)) for i, u in rows if u == t)[2] for _, t in rows}
        assert got == sorted(least.items())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 299)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r["node"]: r["root"] for r in found}
    assert len(found) == len(root)
    assert all(root[i] == 0 for i in range(41)) and all(root[100 + i] == 100 for i in range(60)) and root[300] == 299
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, n=700, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).round(2).tolist()) for i in range(n)]
    rows[40] = (40, rows[20][1])
    rows += [(900 + i, rows[20][1]) for i in range(120)]  # many copies: ties
    odd = [(2000, None), (2020, []), (2040, [float("nan")] * dim), (2060, [float("inf")] + [0.0] * (dim - 1)), (2080, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim), (2100, [0.0] * dim), (2101, [1.0, 2.0]), (60, rows[60][1])]
    return rows + odd, spark.createDataFrame([(*r, "c", 1) for r in rows + odd], "vec_id long, embedding array<float>, vector string, block int").repartition(4)


def brute(rows, score, zero, every=20, k=20):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            usable[i] = np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v)))
    out = {}
    for q in (i for i in usable if i % every == 0):
        best = sorted((-score(usable[q], usable[i]), i) for i in usable if i != q)[:k]
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def asked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("size", [blocks.CANDIDATES, 90])
def test_top_scores(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "CANDIDATES", size)
    monkeypatch.setattr(blocks, "LEAST_QUERIES", 17)
    rows, df = vectors(spark)
    whole = lambda a, b: int((np.floor(64 * a).astype(int) * np.floor(64 * b).astype(int)).sum())
    assert asked(topk.top_scores(df)) == brute(rows, whole, zero=True)
    few = df.where("vec_id < 45")
    assert asked(topk.top_scores(few, k=60)) == brute([r for r in rows if r[0] is not None and r[0] < 45], whole, zero=True, k=60)
    assert topk.top_scores(df.where("false")).count() == 0


def meets(x, scale=64, k=20, queries=40, block=1500):
    """meet()'s share of entries read, after its result is held against brute force."""
    ids = np.arange(len(x)) * 3
    stock = [(ids[i::parts], x[i::parts]) for parts in [-(-len(x) // block)] for i in range(parts)]
    at, found, scores, share = topk.meet(ids[::20][:queries], x[::20][:queries], stock, k, scale)
    v = [[int(a) for a in np.floor(scale * r)] for r in x]
    for q in range(min(queries, len(x[::20]))):
        exact = [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v[20 * q], w)))) for w in v]
        want = sorted((-s, i) for i, s in enumerate(exact) if i != 20 * q)[:k]
        assert [(-s, i) for s, i in zip(scores[at == q].tolist(), (found[at == q] // 3).tolist())] == want
    return share


def test_lists_are_read_no_further_than_needed():
    rng = np.random.default_rng(0)
    assert meets(rng.normal(size=(6000, 32)) * np.exp(-np.arange(32) / 4)) < 0.35  # few components matter
    assert meets(rng.normal(size=(6000, 32)) * (rng.random((6000, 32)) < 0.1)) < 0.35  # most parts are zero
    assert meets(rng.normal(size=(6000, 8))) < 0.8  # few components
    assert meets(rng.normal(size=(3000, 32)) / 8) <= 1  # many alike: the worst case
    assert meets(rng.integers(-1, 2, size=(3000, 8)) / 64) < 0.9  # ties everywhere


def test_any_component_is_scored():
    rng = np.random.default_rng(0)
    v = np.floor(rng.normal(size=(300, 5)) * 1e3)
    for scale in (1.0, 1e6, 1e9, 1e30, 1e300):  # sums beyond doubles' whole numbers, 64 bits, all bounds
        meets(v * scale, k=5, queries=10)
    meets(np.zeros((50, 3)), k=5)
    meets(np.where(np.arange(300)[:, None] % 50 == 7, 1e30, v), k=5)


@pytest.mark.parametrize("rows_at_once", [1 << 20, 300])
def test_nearest(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(ann, "CODES", rows_at_once)
    monkeypatch.setattr(blocks, "LEAST_QUERIES", 17)
    rows, df = vectors(spark)
    dot = lambda a, b: float((a * b).sum())
    got, want = asked(ann.nearest(df, rerank=100)), brute(rows, dot, zero=False)
    assert set(got) == set(want)
    hit = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert all([r for r, _, _ in got[q]] == list(range(1, len(got[q]) + 1)) and len(got[q]) == len(want[q]) for q in want)
    exact = {(q, i): s for q in want for _, i, s in brute(rows, dot, zero=False, k=10_000)[q]}
    assert all(abs(s - exact[q, i]) < 1e-9 for q in got for _, i, s in got[q])
    ids = lambda best: [i for _, i, _ in best]
    assert ids(got[20]) == ids(want[20]) and ids(got[900]) == ids(want[900])  # copies of one vector, more than are ranked: the smallest ids
    assert ann.nearest(df.where("false")).count() == 0


def test_recall(spark):
    """50,000 vectors, of which under 2 % are ranked exactly."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50_000, 32)).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = asked(ann.nearest(rows, every=500, rerank=900))
    hit = 0
    for q, best in got.items():
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        hit += len(set(np.argsort(-scores)[:20].tolist()) & {i for _, i, _ in best})
    assert len(got) == 100 and hit >= 0.9 * 20 * len(got)


def test_scan_keeps_the_largest_sums():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 7))
    q = ann.Quantiser(x)
    codes = q.pack(x)
    full = q.scan(x[:9], codes).T.astype(int)
    for rows in (8_192, 64, 1):
        places, sums = ann.scan_best(q, x[:9], codes, 30, rows=rows, at_once=4)
        assert (np.sort(sums, axis=1)[:, ::-1] == np.sort(full, axis=1)[:, ::-1][:, :30]).all()
        assert (np.take_along_axis(full, places, axis=1) == sums).all() and all(len(set(p)) == 30 for p in places.tolist())


def test_parallel_residuals_cost_more():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = ann.Quantiser(x)
    parts = ann.split(x)
    loss = []
    for plain in (True, False):
        codes = q.codes(parts, plain=plain)
        r = (parts - np.stack([q.centres[m][codes[:, m]] for m in range(parts.shape[1])], axis=1)).reshape(len(x), -1)
        along = (r * parts.reshape(len(x), -1)).sum(axis=1)
        loss.append(((r**2).sum(axis=1) + (q.eta - 1) * along**2).mean())
    assert loss[1] < loss[0]
