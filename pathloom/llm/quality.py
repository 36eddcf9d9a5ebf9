"""Quality rules: document statistics, fixed rules, and gradient-boosted trees over them.

The trees are grown here from labelled rows with a second-order logistic loss
and monotonic constraints, then flattened into numpy arrays that score whole
batches level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, map_rows, materialize, mix64, release, word_spans

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Inputs of the trees, each with the sign of its constraint: 1 if more of it may
#: only raise the chance that a document is kept, -1 if it may only lower it.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "punctuation_share": 0, "distinct_share": 0, "mean_line_words": 0,
    "short_word_share": 0, "stop_share": 0, "end_mark_share": 0, "top_word_share": -1,
}


class Statistics:
    """Base counts and tree features of whole texts."""

    def __init__(self) -> None:
        self.hash = WordHasher()

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        text = text or ""
        data = text.encode()
        words = self.hash(data)
        n = len(words)
        gaps = sum(text.count(c) for c in _SPACES)
        chars = len(text) - gaps
        symbols = sum(text.count(c) for c in SYMBOLS)
        lines = [line for line in text.split("\n") if line and line.strip(_SPACES)]
        dup = len(lines) - len(set(lines))
        repeat = self._repeated(words)
        counts = [n, chars, symbols, dup, repeat]
        if not n:
            return counts, [0.0] * len(FEATURES)
        raw = np.frombuffer(data, dtype=np.uint8)
        kinds = np.bincount(raw, minlength=256)
        upper, lower, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
        marks = kinds[[33, 44, 46, 58, 59, 63]].sum()
        sizes = word_spans(data)[2]
        _, times = np.unique(words, return_counts=True)
        ended = kinds[[33, 46, 63]].sum()
        features = [
            np.log1p(n), chars / n, symbols / chars, dup / max(1, len(lines)), repeat / n,
            upper / max(1, upper + lower), digits / len(raw), marks / n, len(times) / n, n / max(1, len(lines)),
            np.mean(sizes <= 2), np.mean(sizes == 3), ended / max(1, len(lines)), times.max() / n,
        ]
        return counts, [float(x) for x in features]

    @staticmethod
    def _repeated(words: np.ndarray) -> int:
        """Words that lie in a 3-word window found at least twice."""
        if len(words) < 4:
            return 0
        with np.errstate(over="ignore"):
            windows = mix64(mix64(mix64(words[:-2], 1) + words[1:-1], 2) + words[2:], 3)
        order = np.argsort(windows, kind="stable")
        ordered = windows[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(windows), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        inside = np.zeros(len(words), dtype=bool)
        for j in range(3):
            inside[j : j + len(windows)] |= twice
        return int(inside.sum())


# ------------------------------------------------------------------- the trees


@dataclass(frozen=True)
class Trees:
    """Flattened trees, one row a tree: inner nodes first, children of i at 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.bias)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(
    x: np.ndarray, y: np.ndarray, signs: list[int], *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, min_rows: int = 5
) -> Trees:
    """Boost trees on (rows, features) with 0/1 targets; ties in gain go to the first feature and bin."""
    inner = 2**depth - 1
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    rate_1 = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    bias, score = float(np.log(rate_1 / (1 - rate_1))), np.full(len(y), np.log(rate_1 / (1 - rate_1)))
    out = ([], [], [])
    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        value = np.zeros(2 * inner + 1)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        value[0] = g.sum() / (h.sum() + l2)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            value[2 * node + 1] = value[2 * node + 2] = value[node]
            low[[2 * node + 1, 2 * node + 2]], high[[2 * node + 1, 2 * node + 2]] = low[node], high[node]
            split = _best(binned, g, h, mine, edges, signs, l2, low[node], high[node], min_rows)
            if split is None:
                at[mine] = 2 * node + 1
                continue
            j, cut, left, right = split
            feature[node], threshold[node] = j, edges[j][cut]
            value[2 * node + 1], value[2 * node + 2] = left, right
            if signs[j]:
                middle = (left + right) / 2
                below, above = (2 * node + 1, 2 * node + 2) if signs[j] > 0 else (2 * node + 2, 2 * node + 1)
                high[below], low[above] = middle, middle
            at[mine] = 2 * node + 1 + (binned[mine, j] > cut)
        leaf = rate * value[inner:]
        score = score + leaf[at - inner]
        for kept, new in zip(out, (feature, threshold, leaf), strict=True):
            kept.append(new)
    shapes = ((0, inner), (0, inner), (0, inner + 1))
    arrays = [np.stack(a) if a else np.zeros(s, dtype=np.int64 if i == 0 else float) for i, (a, s) in enumerate(zip(out, shapes, strict=True))]
    return Trees(*arrays, bias, depth)


def _best(binned, g, h, mine, edges, signs, l2, low, high, min_rows):
    """The split of a node with the largest gain whose children keep order and bounds."""
    if len(mine) < 2 * min_rows:
        return None
    gm, hm = g[mine], h[mine]
    total = gm.sum() ** 2 / (hm.sum() + l2)
    best, found = 1e-6, None
    for j, edge in enumerate(edges):
        width = len(edge) + 1
        b = binned[mine, j]
        gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=width))[:-1] for w in (gm, hm, np.ones(len(b))))
        gr, hr, nr = gm.sum() - gl, hm.sum() - hl, len(b) - nl
        left, right = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
        gain = 2 * (left * gl + right * gr) - left**2 * (hl + l2) - right**2 * (hr + l2) - total
        allowed = (nl >= min_rows) & (nr >= min_rows)
        if signs[j]:
            allowed &= signs[j] * (right - left) >= 0
        gain = np.where(allowed, gain, -np.inf)
        if len(gain) and gain.max() > best:
            cut = int(gain.argmax())
            best, found = gain[cut], (j, cut, float(left[cut]), float(right[cut]))
    return found


# ----------------------------------------------------------------- on DataFrames

_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, base counts, features array) of every whole text; a null text has no words."""

    def make():
        count = Statistics()

        def work(c):
            both = [count(t) for t in c["text"]]
            return {k: c[k] for k in ("doc_id", *keep)} | {"features": [f for _, f in both]} | {
                name: [b[i] for b, _ in both] for i, name in enumerate(BASE)
            }

        return work

    types = dict(docs.dtypes)
    kept = "".join(f", `{k}` {types[k]}" for k in keep)
    return map_rows(docs.select("doc_id", *keep, "text"), make, _STATS + kept + ", features array<double>")


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, seed: int = 17) -> Trees:
    """Trees for the chance that a document's quality label is 1.

    Learns from at most about ``max_labelled`` labelled rows, drawn by seeded hashes, of
    equal rows from one; null labels and ids are skipped, of a doc_id labelled twice the
    larger label counts. ``docs`` needs doc_id and text, ``labels`` doc_id and quality;
    other columns are ignored. Without labels no document differs in its chance. Only
    statistics of the drawn rows reach the driver.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def drawn(rows: DataFrame, n: int, *key: str) -> DataFrame:
        share = int(1_000_000 * min(1.0, max_labelled / max(1, n)))
        return rows.filter(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < share)

    chosen = materialize(drawn(known, known.count(), "doc_id"), "quality-drawn")
    few = chosen.count() <= 2 * max_labelled  # by the draw about max_labelled rows of two numbers
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen, "doc_id").dropDuplicates(["doc_id", "text"]), "quality-rows")
    n = sample.count()
    some = drawn(sample, n, "doc_id", "text") if n > 1.1 * max_labelled else sample  # several texts of one doc_id
    both = statistics(some.select("doc_id", "text", "quality"), keep=("quality",)).select("doc_id", "quality", "features").collect()
    rows = sorted((r.doc_id, r.quality, r.features) for r in both)
    release(chosen, sample)
    x = np.array([r[2] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return grow(x, np.array([float(r[1]) for r in rows]), list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees, *, threshold: float = 0.5) -> DataFrame:
    """Statistics, the rules' verdict and the trees' for every document.

    base_failed: under 50 words, or over half of the words in repeated 3-word
    windows. kept: not base_failed and score >= ``threshold``. A null or empty
    text has no words and fails. Repeated rows are judged one by one. An empty table
    gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        count, trees = Statistics(), shared.value

        def work(c):
            both = [count(t) for t in c["text"]]
            x = np.array([f for _, f in both], dtype=float).reshape(len(both), len(FEATURES))
            return {"doc_id": c["doc_id"], "score": trees.probability(x).tolist()} | {
                name: [b[i] for b, _ in both] for i, name in enumerate(BASE)
            }

        return work

    scored = map_rows(docs.select("doc_id", "text"), make, _STATS + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
