"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

There are no labelled findings to train on: a run of characters that a pattern matches is a secret; made strings of
public token formats, in pieces of the documents' own text, are secrets or look-alikes; other runs of the documents
are no secrets, but those that resemble one, which have no label. Thresholds find RECALL of held-out secrets.

The network is trained on the findings of all documents, shard by shard: every round each shard's copy passes over its
own findings, and the copies are averaged. Held-out findings of all shards are counted by logit for the thresholds.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterfold.llm.shared import remove, write_table

# The base patterns and the least lengths that their matches need.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "model")
#: One of them is in every text that ASSIGN matches (lower case).
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A candidate: a run of CHARS, of CANDIDATE characters or more, with a digit or of ENTROPY bits a character.
CHARS = "A-Za-z0-9+/_.=-"
CANDIDATE, ENTROPY = 16, 3.5
RUN = re.compile(rf"(?<![{CHARS}])[{CHARS}]{{{CANDIDATE},}}")
DIGIT = re.compile("[0-9]")
#: Words before a value that say it is a key.
KEY = re.compile(r"key|token|secret|passw|pwd|credential|bearer|auth", re.I)
BEFORE, INSIDE, AFTER = 32, 64, 24
WIDTH = BEFORE + INSIDE + AFTER
#: Windows of a longer candidate begin so many characters apart: what has INSIDE - STEP of them or fewer is whole in one.
STEP = 16
#: A path's name that is no part of a secret: lower case, with one short number at most.
PLAIN = re.compile(r"[a-z._=-]*[0-9]{0,4}[a-z._=-]*")
OTHER, PAD = 96, 97

#: Findings of a shard, about, passes over all shards, and one finding of so many is held out of training.
SHARD, ROUNDS, HELD_OUT = 8_192, 8, 5
#: Made findings at least, half of them secrets (each document has one, or more if there are few), and the share of
#: secrets that thresholds must find.
MADE, RECALL = 7_200, 0.97
#: Networks are added up in whole numbers of 2^-FIXED, so that their average doesn't depend on the order, and held-out
#: logits are counted down to whole numbers of 1/LOGITS.
FIXED, LOGITS = 40, 256
#: Labelled secrets that a family of candidates needs for a threshold of its own.
LEAST_LABELLED = 30
REDACTED = "[SECRET]"

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the pattern matches, in code points, by start and then kind."""
    low = text.lower()
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy(value: str) -> float:
    """Bits a character, by the value's own frequencies."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate."""
    return [m.span() for m in RUN.finditer(text) if DIGIT.search(m[0]) or entropy(m[0]) >= ENTROPY]


def resembles(text: str, start: int, end: int) -> bool:
    """Whether a finding that no pattern matched may be a secret all the same: it stands after a word for keys, or
    has a part of high entropy that mixes lower case, upper case and digits (two of them at least)."""
    if KEY.search(text[max(0, start - BEFORE) : start]):
        return True
    parts = [p for p in re.split(r"[/_.=-]", text[start:end]) if len(p) >= CANDIDATE]
    kinds = lambda p: bool(re.search("[a-z]", p)) + bool(re.search("[A-Z]", p)) + bool(DIGIT.search(p))
    return any(kinds(p) >= 2 and entropy(p) >= ENTROPY for p in parts)


def window(text: str, start: int, end: int) -> tuple[str, int]:
    """The candidate in its context, WIDTH characters at most, and how many of them stand before it."""
    return text[max(0, start - BEFORE) : start] + text[start : min(end, start + INSIDE)] + text[end : end + AFTER], min(start, BEFORE)


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping parts, of INSIDE characters at most, in which a candidate is looked at."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in (*range(start, end - INSIDE, STEP), end - INSIDE)]


def left(start: int, end: int, spans: list[Span]) -> list[tuple[int, int]]:
    """What the spans leave of a candidate, in parts of CANDIDATE characters or more."""
    out = []
    for s, _, e in spans:
        if s < end and start < e:
            out.append((start, s))
            start = max(start, e)
    return [(a, b) for a, b in (*out, (start, end)) if b - a >= CANDIDATE]


def marked(text: str, start: int, end: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a candidate that the windows `found` (ascending) cover, each out to the next slash, without
    the plain path names at its ends."""
    parts: list[tuple[int, int]] = []
    for a, b in found:
        a = max(start, text.rfind("/", start, a + 1) + 1)
        stop = text.find("/", b - 1, end)
        b = end if stop < 0 else stop
        if parts and a <= parts[-1][1]:
            parts[-1] = (parts[-1][0], max(b, parts[-1][1]))
        elif a < b:
            parts.append((a, b))
    out = []
    for a, b in parts:
        names = text[a:b].split("/")
        odd = [i for i, n in enumerate(names) if not PLAIN.fullmatch(n)]
        if odd:
            a, b = a + sum(len(n) + 1 for n in names[: odd[0]]), b - sum(len(n) + 1 for n in names[odd[-1] + 1 :])
        out.append((a, b))
    return out


def family(value: str) -> int:
    """0: hexadecimal, 1: digits and marks, 2: others. Thresholds are set for each."""
    return 0 if re.fullmatch(r"[0-9a-fA-F]+", value) and not value.isdigit() else 1 if not re.search("[A-Za-z]", value) else 2


def features(items: list[tuple[str, int, int]]) -> np.ndarray:
    """(items, WIDTH): character codes, aligned so that candidates begin at BEFORE; those of candidates + 98."""
    out = np.full((len(items), WIDTH), PAD, np.int64)
    for row, (text, start, end) in zip(out, items, strict=True):
        shown, lead = window(text, start, end)
        codes = np.frombuffer(shown.encode("ascii", "replace"), np.uint8).astype(np.int64) - 32
        codes = np.where((codes < 0) | (codes > 95), OTHER, codes)
        codes[lead : lead + min(end - start, INSIDE)] += PAD + 1
        row[BEFORE - lead : BEFORE - lead + len(codes)] = codes
    return out


class Network:
    """Embedding, convolution, rectifier, maximum over positions, hidden layer, one logit; in numpy."""

    EMBED, KERNEL, FILTERS, HIDDEN = 10, 7, 32, 16

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, np.sqrt(2 / shape[0]), shape).astype(np.float32)
        self.w = {
            "e": rng.normal(0, 0.3, (2 * (PAD + 1), self.EMBED)).astype(np.float32), "k": init(self.KERNEL * self.EMBED, self.FILTERS), "kb": np.zeros(self.FILTERS, np.float32),
            "h": init(self.FILTERS, self.HIDDEN), "hb": np.zeros(self.HIDDEN, np.float32), "o": init(self.HIDDEN, 1), "ob": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.w
        e = w["e"][x]
        spans = np.lib.stride_tricks.sliding_window_view(e, self.KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.KERNEL * self.EMBED)
        c = np.maximum(spans @ w["k"] + w["kb"], 0)
        best = c.argmax(axis=1)
        pooled = np.take_along_axis(c, best[:, None], axis=1)[:, 0]
        h = np.maximum(pooled @ w["h"] + w["hb"], 0)
        return (h @ w["o"] + w["ob"])[:, 0], (spans, best, pooled, h)

    def gradients(self, x: np.ndarray, kept: tuple, slope: np.ndarray) -> dict:
        spans, best, pooled, h = kept
        w, n = self.w, len(x)
        g = {"o": h.T @ slope[:, None], "ob": slope.sum(keepdims=True)}
        dh = slope[:, None] * w["o"][:, 0] * (h > 0)
        g |= {"h": pooled.T @ dh, "hb": dh.sum(axis=0)}
        dp = dh @ w["h"].T * (pooled > 0)
        at = spans[np.arange(n)[:, None], best]  # (n, filters, kernel * embed)
        g |= {"k": np.einsum("nfk,nf->kf", at, dp), "kb": dp.sum(axis=0)}
        de = np.zeros_like(w["e"])
        moved = (dp[:, :, None] * w["k"].T).reshape(n, self.FILTERS, self.KERNEL, self.EMBED)
        np.add.at(de, x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(self.KERNEL)], moved)
        return g | {"e": de}

    def moments(self) -> tuple[dict, dict]:
        return {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}

    def epoch(self, x: np.ndarray, y: np.ndarray, m: dict, v: dict, step: float, rng: np.random.Generator, batch: int = 128, rate: float = 3e-3) -> float:
        """One pass in an order of its own; m and v are the moments of gradients, step counts the batches."""
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            logit, kept = self.forward(x[rows])
            slope = ((1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)).astype(np.float32)
            step += 1
            for k, g in self.gradients(x[rows], kept, slope).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return step

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = ROUNDS, seed: int = 0) -> None:
        rng, step, (m, v) = np.random.default_rng(seed), 0, self.moments()
        for _ in range(epochs):
            step = self.epoch(x, y, m, v, step, rng)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[at : at + 512])[0] for at in range(0, len(x), 512)]) if len(x) else np.zeros(0)


class Detector:
    """A network with calibrated probabilities and a threshold for each family of candidates."""

    def __init__(self, network: Network, scale: float, shift: float, limits: np.ndarray):
        self.network, self.scale, self.shift, self.limits = network, scale, shift, limits

    def probabilities(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.network.logits(features(items)) + self.shift)))

    def secret(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        kinds = np.array([family(t[a:b]) for t, a, b in items], int)
        return self.probabilities(items) >= self.limits[kinds] if items else np.zeros(0, bool)


def calibrated(network: Network, x: np.ndarray, y: np.ndarray, kinds: np.ndarray, recall: float = RECALL) -> Detector:
    """The detector of held-out findings, see `limited`."""
    return limited(network, network.logits(x), y, kinds, np.ones(len(x)), recall)


def limited(network: Network, z: np.ndarray, y: np.ndarray, kinds: np.ndarray, times: np.ndarray, recall: float = RECALL) -> Detector:
    """Platt scaling on held-out findings (logits z, labels, families, and how many there are of each), then each
    family's threshold: half-way (in logits) from the highest that still finds `recall` of its secrets down to the
    next finding that is none. So as few others are taken as at the highest, and where both are well apart, more
    secrets. A family of few labelled secrets has the threshold of all."""
    scale, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -500, 500)))
        w, d = times * np.maximum(p * (1 - p), 1e-6), times * (p - y)
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, [(d * z).sum() + 1e-3 * (scale - 1), d.sum()])
        scale, shift = scale - 0.5 * move[0], shift - 0.5 * move[1]
    limits = np.zeros(3)
    for f in range(3):
        own = (kinds == f) if times[(kinds == f) & (y == 1)].sum() >= LEAST_LABELLED else np.ones(len(y), bool)
        secret, other = scale * z[own & (y == 1)] + shift, scale * z[own & (y == 0)] + shift
        order = np.argsort(secret)
        there = np.cumsum(times[own & (y == 1)][order])
        top = secret[order][np.searchsorted(there, np.floor((1 - recall) * there[-1]), side="right")] if len(secret) else np.inf
        below = other[other < top]
        limits[f] = 1 / (1 + np.exp(-(top + (below.max() if len(below) else top)) / 2))
    return Detector(network, float(scale), float(shift), limits)


def _formats(rng: np.random.Generator) -> tuple[list[Callable], list[Callable]]:
    """Makers of (lead, value, label): labelled findings in public token formats, and look-alikes that are no secrets."""
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    mixed = lower + upper + digit
    n = int(rng.integers(20, 48))
    word = lambda: pick(lower, int(rng.integers(3, 10)))
    secret = [
        lambda: (" ", "ghp_" + pick(mixed, 36), 1), lambda: (" ", f"xoxb-{pick(digit, 11)}-{pick(digit, 11)}-{pick(mixed, 24)}", 1), lambda: (" ", "sk_live_" + pick(mixed, 24), 1),
        lambda: (" ", "eyJ" + pick(mixed, 20) + "." + pick(mixed, 40) + "." + pick(mixed + "-_", 30), 1), lambda: (" key ", pick(mixed + "+/", n) + "==", 1), lambda: (" ", pick(mixed, n), 1),
        lambda: (" pwd ", pick(mixed + "_-", n), 1), lambda: (" credential ", pick(hexa.upper(), 32), 1), lambda: (" ", pick(hexa.upper(), 40), 1), lambda: (" bearer ", pick(mixed, n), 1),
        lambda: (" ", pick(lower + upper, n), 1), lambda: (" ", pick(lower + upper + "+/", n) + "=", 1),
    ]
    other = [
        lambda: (" ", pick(digit, 16), 0), lambda: (" ", f"{pick(digit, 4)}-{pick(digit, 4)}-{pick(digit, 4)}-{pick(digit, 4)}", 0), lambda: ("@", f"mail{pick(digit, 1)}.{word()}.{word()}", 0),
        lambda: ("//", f"www.{word()}{pick(digit, 2)}.example/{word()}/{pick(digit, 4)}", 0), lambda: (" /", f"{word()}/{word()}/{word()}_{pick(digit, 2)}.{word()}", 0), lambda: (" ", f"{pick('12', 1)}{pick(digit, 3)}-{pick('01', 2)}-{pick('12', 2)}T{pick('01', 2)}", 0),
        lambda: (" ", f"{word()}-{word()}-{word()}-{pick(digit, 1)}.{pick(digit, 1)}.{pick(digit, 2)}", 0), lambda: (" ", f"{word()}{word()}{word()}{pick(digit, 1)}", 0), lambda: (" ", f"{pick(digit, 8)}.{pick(digit, 8)}", 0), lambda: (" ", f"{word()}_{word()}_{pick(digit, 3)}_{word()}", 0),
        lambda: (" ", word() + "".join(word().title() for _ in range(4)), 0), lambda: (" ", "-".join(word() for _ in range(5)), 0),
    ]
    return secret, other


def _made(rng: np.random.Generator) -> Iterator[tuple[str, str, int]]:
    """(lead, value, label) of every format in turn."""
    while True:
        for makers in _formats(rng):
            yield from [f() for f in makers]


Finding = tuple[str, int, int, int]  # text around, start and end in it, label
BARE: Finding = ("the value is here and so on", 13, 13, -1)


def findings(text: str) -> list[Finding]:
    """The labelled findings of a text, in their context: candidates, secret where a pattern found them, and left
    out where none did but they resemble one."""
    spans, out = base_spans(text), []
    for start, end in candidates(text):
        for a, b in windows(start, end):
            label = any(s < b and a < e for s, _, e in spans)
            if label or not resembles(text, a, b):
                shown, lead = window(text, a, b)
                out.append((shown, lead, lead + b - a, int(label)))
    return out


def soil(text: str, pieces: int = 4) -> list[Finding]:
    """Pieces of plain text for made findings to stand in, at places that the text's length gives; label -1."""
    places = [(len(text) * (2 * i + 1)) // (2 * pieces) for i in range(pieces)] if text else []
    return [(text[max(0, p - BEFORE) : p + AFTER], p - max(0, p - BEFORE), p - max(0, p - BEFORE), -1) for p in places]


def placed(ground: Finding, lead: str, value: str) -> tuple[str, int, int]:
    """A made finding in a piece of plain text."""
    text, at, _, _ = ground
    before = text[max(0, at - BEFORE) : at].rstrip("0123456789+/_.=-") + lead
    return before + value + " " + text[at : at + AFTER].lstrip(), len(before), len(before) + len(value)


def made_in(text: str, times: int) -> list[Finding]:
    """Made findings, `times` of them, in pieces of a document's own text; which ones is the text's affair."""
    rng, ground, out = np.random.default_rng(zlib.crc32(text.encode())), soil(text) or [BARE], []
    for _ in range(times):
        makers = [f for both in _formats(rng) for f in both]
        lead, value, label = makers[int(rng.integers(len(makers)))]()
        out.append((*placed(ground[int(rng.integers(len(ground)))], lead, value), label))
    return out


def labelled(found: list[Finding], seed: int = 0) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Findings with labels: those given, and made ones in the pieces of plain text that are given."""
    items, labels = [f[:3] for f in found if f[3] >= 0], [f[3] for f in found if f[3] >= 0]
    rng = np.random.default_rng(seed)
    ground = [f for f in found if f[3] < 0] or [BARE]
    made = _made(rng)
    for _ in range(MADE):
        lead, value, label = next(made)
        items.append(placed(ground[int(rng.integers(len(ground)))], lead, value))
        labels.append(label)
    return items, np.array(labels, np.float32)


def train(found: list[Finding], seed: int = 0) -> Detector:
    """Fits on four fifths of the labelled findings, calibrates on the rest."""
    items, y = labelled(found, seed)
    kinds = np.array([family(t[a:b]) for t, a, b in items], int)
    x = features(items)
    held = np.random.default_rng(seed).random(len(x)) < 0.2
    network = Network(seed)
    network.fit(x[~held], y[~held], seed=seed)
    return calibrated(network, x[held], y[held], kinds[held])


def scored(texts: list[str], detector: Detector) -> tuple[list[list[Span]], list[int]]:
    """(all spans of every text, how many of its patterns' spans the network confirms). Every candidate is looked at,
    what a pattern matched included; the network adds spans only where no pattern matched."""
    base = [base_spans(t) for t in texts]
    items: list[tuple[str, int, int]] = []
    owners: list[tuple[int, int, int, int]] = []  # text, candidate, and the pattern's span or -1
    for i, (t, found) in enumerate(zip(texts, base, strict=True)):
        parts = [(*rest, -1) for c in candidates(t) for rest in left(*c, found)]
        for start, end, span in [*parts, *((s, e, k) for k, (s, _, e) in enumerate(found))]:
            for a, b in windows(start, end):
                items.append((t, a, b))
                owners.append((i, start, end, span))
    secret: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    confirmed: set[tuple[int, int]] = set()
    for at in range(0, len(items), 4096):
        part = items[at : at + 4096]
        for (_, a, b), (i, start, end, span), yes in zip(part, owners[at : at + 4096], detector.secret(part), strict=True):
            if yes and span < 0:
                secret.setdefault((i, start, end), []).append((a, b))
            elif yes:
                confirmed.add((i, span))
    out = [list(s) for s in base]
    for (i, start, end), found in secret.items():
        out[i] += [(a, 3, b) for a, b in (marked(texts[i], start, end, found) if end - start > INSIDE else found)]
    counts = Counter(i for i, _ in confirmed)
    return [sorted(s) for s in out], [counts[i] for i in range(len(texts))]


def spans_of(texts: list[str], detector: Detector) -> list[list[Span]]:
    """All spans of every text: the patterns', and what the network calls secret of the other candidates."""
    return scored(texts, detector)[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def all_findings(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, int, str]:
    """text, start, end, label of the different findings of all documents, made ones in their own text included; how
    many there are, and the scratch table's path."""
    names, spark = ["text", "start", "end", "label"], df.sparkSession
    times = -(-MADE // max(1, df.count())) or 1

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string() if not i else pa.int32()) for i in range(4)], names)

    def run(batches):
        found: list[Finding] = []
        for batch in batches:
            for t in batch.column(0):
                text = t.as_py() or ""
                found += findings(text)
                found += made_in(text, times)
                if len(found) >= SHARD:
                    yield batch_of(found)
                    found = []
        yield batch_of(found)

    schema = "text string, start int, end int, label int"
    table, path = write_table(df.select(F.col(text_col).alias("text")).mapInArrow(run, schema).distinct(), "findings")
    count = table.count()
    if count >= MADE:
        return table, count, path
    # Few different texts: made findings stand in plain words, too.
    items, labels = labelled([])
    more = spark.createDataFrame([(*item, int(label)) for item, label in zip(items, labels, strict=True)], schema)
    return table.unionByName(more).distinct(), count + len(items), path


def shards(found: DataFrame, count: int) -> tuple[DataFrame, str]:
    """shard, codes, y, kinds, held: findings as the network sees them, dealt by hash into shards of SHARD, about, in
    an order of their own; one row a shard."""
    names = ["text", "start", "end", "label"]
    parts = -(-count // SHARD)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in names])
        rows = list(zip(*(table.column(c).to_pylist() for c in names[:3]), strict=True))
        codes = zstandard.compress(features(rows).astype(np.uint8).tobytes(), 1)
        kinds = np.array([family(t[a:b]) for t, a, b in rows], np.uint8)
        y, held = (table.column(c).to_numpy().astype(np.uint8) for c in ("label", "held"))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "codes": [codes], "y": [y.tobytes()], "kinds": [kinds.tobytes()], "held": [held.tobytes()]})

    dealt = found.select(*names, F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int").alias("shard"), (F.pmod(F.xxhash64(F.lit("held"), *names), F.lit(HELD_OUT)) == 0).cast("int").alias("held"))
    # A file of its own for each, so that a scan's tasks have few.
    return write_table(dealt.repartitionById(parts, F.col("shard")).groupBy("shard").applyInArrow(run, "shard int, codes binary, y binary, kinds binary, held binary"), "shards")


def opened(batches: Iterator[pa.RecordBatch], held: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, features, labels, families) of every shard's findings that are held out, or of the others."""
    for batch in batches:
        for shard, codes, *rest in zip(*(batch.column(c) for c in ("shard", "codes", "y", "kinds", "held")), strict=True):
            y, kinds, out = (np.frombuffer(r.as_buffer(), np.uint8) for r in rest)
            mine = out == held
            x = np.frombuffer(zstandard.decompress(codes.as_buffer()), np.uint8).reshape(-1, WIDTH)[mine]
            yield shard.as_py(), x.astype(np.int64), y[mine].astype(np.float32), kinds[mine].astype(np.int64)


def trained(parts: DataFrame, seed: int = 0) -> Network:
    """The network after ROUNDS passes over all shards, averaged (with its moments) over the shards after each."""
    context, network = parts.sparkSession.sparkContext, Network(seed)
    m, v = network.moments()
    names, step = sorted(network.w), 0.0
    size = sum(network.w[k].size for k in names)

    def flat(*dicts):
        return np.concatenate([d[k].ravel() for d in dicts for k in names]).astype(float)

    def shaped(values, like):
        ends = np.cumsum([like[k].size for k in names])
        return {k: part.reshape(like[k].shape).astype(np.float32) for k, part in zip(names, np.split(values, ends[:-1]), strict=True)}

    for r in range(ROUNDS):
        sent = context.broadcast((network.w, m, v, step))

        def run(batches, sent=sent, r=r):
            total = np.zeros(3 * size + 2, np.int64)
            for shard, x, y, _ in opened(batches, False):
                if not len(x):
                    continue
                own = Network(seed)
                own.w, m, v = ({k: a.copy() for k, a in d.items()} for d in sent.value[:3])
                step = own.epoch(x, y, m, v, sent.value[3], np.random.default_rng((seed, r, shard)))
                # Roots of the second moments, as small ones would be lost; a count of batches as a small number.
                values = np.concatenate([flat(own.w, m, {k: np.sqrt(a) for k, a in v.items()}), [step / 1024, 1.0]])
                total += np.rint(values * (1 << FIXED)).astype(np.int64)
            if total[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])

        # 3 * size + 2 numbers go to the driver, whatever the corpus.
        rows = parts.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        sent.destroy()
        total = np.zeros(3 * size + 2)
        total[rows["at"]] = rows["value"]
        mean = total[:-1] / total[-1]
        network.w, m, v, step = shaped(mean[:size], network.w), shaped(mean[size : 2 * size], m), shaped(mean[2 * size : -1] ** 2, v), 1024 * float(mean[-1])
    return network


def fitted(df: DataFrame, text_col: str = "text") -> Detector:
    """Trained on the findings of all documents but the held-out fifth, which sets the thresholds. To the driver go
    networks' sums, and how many held-out findings have each logit, to 1/LOGITS: their number is bounded."""
    found, count, path = all_findings(df, text_col)
    parts, packed = shards(found, count)
    network = trained(parts)
    sent = df.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for _, x, y, kinds in opened(batches, True):
            if not len(x):
                continue
            # Down, so that a threshold at a logit's lower end finds all that is counted there.
            z = np.floor(sent.value.logits(x) * LOGITS).astype(np.int64)
            rows, times = np.unique(np.stack([z, y.astype(np.int64), kinds]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*rows, times)], ["z", "y", "kind", "times"])

    rows = parts.mapInArrow(run, "z long, y long, kind long, times long").groupBy("z", "y", "kind").agg(F.sum("times").alias("times")).toPandas().sort_values(["z", "y", "kind"])
    remove(df.sparkSession, path, packed)
    return limited(network, rows["z"].to_numpy() / LOGITS, rows["y"].to_numpy(float), rows["kind"].to_numpy(), rows["times"].to_numpy(float))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", detector: Detector | None = None) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed for every row.

    spans: kind:start:end (code points, end exclusive) by start and then kind, comma-joined; base_sha256 is
    the SHA-256 of the same string of the base kinds alone; n_confirmed: how many base spans the network calls
    secret, too. The network is trained on the findings of all documents and applied to every candidate of every
    whole text, however long, in one pass without a shuffle. A null or empty text has no
    spans; ids may be null or repeated, each row is scanned; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    sent = df.sparkSession.sparkContext.broadcast(detector or fitted(df, text_col))
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found, confirmed = scored([t or "" for t in part.column(1).to_pylist()], sent.value)
                counts = [pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64()) for kind in range(3)]
                digests = [hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(s) for s in found], pa.string()), pa.array(confirmed, pa.int64())], names)

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
    return out.withColumnRenamed("id", id_col)


def hidden(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping ones, replaced by REDACTED."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], REDACTED]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", detector: Detector | None = None) -> DataFrame:
    """df with secrets of text_col replaced and length_col set anew where text changed; rows and columns stay, extra
    columns of any name included. Null and empty texts stay as they are; texts of any length are scanned whole;
    ids may be null or repeated; an empty table gives no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(detector or fitted(df, text_col))
    text_at = df.columns.index(text_col)
    length_at = df.columns.index(length_col) if length_col in df.columns else None

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(text_at).to_pylist()
                found = spans_of([t or "" for t in texts], sent.value)
                new = [hidden(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                columns = list(part.columns)
                columns[text_at] = pa.array(new, columns[text_at].type)
                if length_at is not None:
                    old = columns[length_at].to_pylist()
                    columns[length_at] = pa.array([len(n) if s else o for n, s, o in zip(new, found, old, strict=True)], columns[length_at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)
