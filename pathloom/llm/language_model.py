"""Scores of texts: prediction by partial matching over bytes, and a unigram base.

The corpus gives two kinds of counts in one pass, both over all training rows:
words, and runs of ORDER + 1 bytes. The byte counts make a context trie: the
contexts of orders 0 to ORDER and the bytes that followed each. A byte's probability
comes from the longest context in the trie; the escape to the next shorter one
has weight q / (n + q) with n followers, q of them distinct (method C), and
symbols that a longer context has already ruled out are excluded.

What follows a context also follows its suffixes, so the symbols excluded at a context
are just the followers of the next longer one. Each context therefore needs three
numbers: n, q, and x, how often its suffix context was followed by one of its own
followers. With them a byte is scored by one look-up for each order down to the one
where it is found. The most frequent contexts, all of them if they are few, are looked
up from a broadcast; runs after any other context meet the trie in joins, order by
order, so no context is left out.

Framing: ORDER 0xFF bytes, which no UTF-8 text holds, start a text and one ends it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, keep_here, map_batches, materialize

EDGE, ORDER = 0xFF, 5
#: Orders whose contexts are all broadcast; the bytes bound them: 256**3 runs, far fewer in UTF-8.
WHOLE = 2
_START, _END = bytes([EDGE] * ORDER), bytes([EDGE])
#: Keys a task gathers before it hands counts on; bytes of text scored at once.
_FLUSH, _TOGETHER = 3_000_000, 500_000
WORD_KIND, RUN_KIND, SUM_KIND = 0, 1, 2


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ORDER + 1 bytes of framed texts as numbers, where each text's begin)."""
    a = np.frombuffer(b"".join([part for t in texts for part in (_START, t, _END)]), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts])
    key = a[: len(a) - ORDER].copy()
    for j in range(1, ORDER + 1):
        key <<= np.uint64(8)
        key |= a[j : len(a) - ORDER + j]
    begin = np.cumsum(sizes) - sizes
    ends_at = np.cumsum(sizes + ORDER)  # runs that reach into the next text's start are left out
    keep = np.ones(len(key), dtype=bool)
    for j in range(ORDER):
        past = ends_at[:-1] - ORDER + j
        keep[past] = False
    return key[keep], begin


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): word hashes, runs of ORDER + 1 bytes, and texts (kind 2, key 0) of all rows."""
    names = ["kind", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHasher()
        held: dict[int, list] = {WORD_KIND: [], RUN_KIND: []}
        texts, size, waiting = 0, 0, []

        def fold() -> None:
            if not waiting:
                return
            found = {WORD_KIND: hashed.many([t.lower() for t in waiting])[0], RUN_KIND: runs_of(waiting)[0]}
            for kind, keys in found.items():
                held[kind].append(np.unique(keys, return_counts=True))
                held[kind] = [_merge(held[kind])] if len(held[kind]) > 1 else held[kind]
            waiting.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                for keys, counts in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=names
                    )
                parts.clear()

        for batch in batches:
            for text in batch.column(0):
                waiting.append((text.as_py() or "").encode())
                texts += 1
                size += len(waiting[-1])
                if size > 4_000_000:
                    fold()
                    size = 0
                    if sum(len(k) for parts in held.values() for k, _ in parts) > _FLUSH:
                        yield from out()
        fold()
        yield from out()
        yield pa.RecordBatch.from_arrays([pa.array([SUM_KIND], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=names)

    pieces = map_batches(docs.select("text"), run, "kind int, key long, n long")
    return pieces.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def above(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n, at most about ``most``: those over an approximate quantile of n, checked."""
    total = counts.count()
    if total <= most:
        return counts
    least = counts.agg(F.percentile_approx("n", 1 - most / total, 10_000).alias("q")).first()["q"]
    while counts.filter(F.col("n") > least).count() > 1.2 * most:
        least *= 2
    return counts.filter(F.col("n") > least)


# --------------------------------------------------------------------- the trie


def _mask(n_bytes: int) -> int:
    return 256**n_bytes - 1


class Trie:
    """Runs and contexts of orders 0 to ``top`` as sorted arrays, those of frequent contexts or all.

    ``runs``: (keys, counts) of some orders, the whole ones among them; lower orders follow
    from the next higher one. ``complete``: whether contexts that are not here do not exist.
    """

    def __init__(self, runs: dict[int, tuple[np.ndarray, np.ndarray]], top: int = ORDER, complete: bool = True) -> None:
        self.top, self.complete = top, complete
        self.keys: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * (top + 1)
        self.n: list[np.ndarray] = [np.zeros(0)] * (top + 1)
        for order in range(top, -1, -1):
            if order in runs:
                keys, counts = runs[order][0].astype(np.uint64), runs[order][1]
                sort = np.argsort(keys)
                self.keys[order], self.n[order] = keys[sort], counts[sort].astype(np.float64)
            else:
                self.keys[order], at = np.unique(self.keys[order + 1] & np.uint64(_mask(order + 1)), return_inverse=True)
                self.n[order] = np.bincount(at, self.n[order + 1], len(self.keys[order]))
        self.contexts, self.total, self.kinds, self.below = [], [], [], []
        for order in range(top + 1):
            keys = self.keys[order] >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
            sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)  # noqa: B023, E731
            self.contexts.append(keys[first])
            self.total.append(sums(self.n[order]))
            self.kinds.append(np.diff(first, append=len(keys)).astype(np.float64))
            if order:
                at, known = self._find(self.keys[order - 1], self.keys[order] & np.uint64(_mask(order)))
                self.below.append(sums(np.where(known, self.n[order - 1][at], 0)))
            else:
                self.below.append(np.zeros(len(first)))
        size = 1 << max(4, int(np.ceil(np.log2(1 + 2 * len(self.keys[top])))))
        self.shift, self.slots = np.uint64(64 - int(np.log2(size))), np.full(size, -1, dtype=np.int32)
        left = np.arange(len(self.keys[top]), dtype=np.int32)
        slot, self.probes = self._slot(self.keys[top]), 0
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            stay = self.slots[slot] != left
            left, slot = left[stay], (slot[stay] + 1) & (size - 1)
            self.probes += 1
        whole = np.repeat(self.total[top] + self.kinds[top], self.kinds[top].astype(np.int64))
        self.log = np.log10(self.n[top] / whole) if len(whole) else np.zeros(0)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the wanted keys, and which of them are there."""
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def logs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probabilities of the last bytes of runs, which of them are after contexts that are not known here)."""
        out, unknown = np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        left, slot = np.arange(len(keys)), self._slot(keys)
        for _ in range(self.probes):
            at = self.slots[slot]
            hit = (at >= 0) & (self.keys[self.top][at] == keys[left])
            out[left[hit]] = self.log[at[hit]]
            more = ~hit & (at >= 0)
            if not hit.all():
                stay = np.flatnonzero(more)
                rest = left[~hit & ~more]
                left, slot = left[stay], (slot[stay] + 1) & (len(self.slots) - 1)
                unknown[rest] = True  # missed, for now
            else:
                left = left[:0]
            if not len(left):
                break
        unknown[left] = True
        missed = np.flatnonzero(unknown)
        unknown[missed] = False
        if not len(missed):
            return out, unknown
        key = keys[missed]
        at, seen = self._find(self.contexts[self.top], key >> np.uint64(8))
        if not self.complete:
            unknown[missed[~seen]] = True
            missed, key, at, seen = missed[seen], key[seen], at[seen], seen[seen]
        total, kinds, below = (np.where(seen, x[self.top][at], 0.0) if len(x[self.top]) else np.zeros(len(key)) for x in (self.total, self.kinds, self.below))
        escape = np.where(seen, kinds / np.maximum(1, total + kinds), 1.0)
        out[missed] = np.log10(self.descend(key, escape, below, kinds, self.top - 1))
        return out, unknown

    def descend(self, keys: np.ndarray, escape: np.ndarray, below: np.ndarray, kinds: np.ndarray, order: int) -> np.ndarray:
        """Probabilities from ``order`` down: ``escape`` so far, and of the context above how often its followers follow here, and how many they are."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for j in range(order, -1, -1):
            run = keys[left] & np.uint64(_mask(j + 1))
            at, found = self._find(self.keys[j], run)
            c, seen = self._find(self.contexts[j], run >> np.uint64(8))
            if not len(self.contexts[j]):
                continue
            n, q = np.where(seen, self.total[j][c] - below, 0), np.where(seen, self.kinds[j][c] - kinds, 0)
            free = n > 0
            whole = np.where(free, n + q, 1)
            out[left[found]] = (escape * self.n[j][at] / whole)[found]
            escape = np.where(free, escape * q / whole, escape)
            below, kinds = np.where(seen, self.below[j][c], below), np.where(seen, self.kinds[j][c], kinds)
            left, escape, below, kinds = left[~found], escape[~found], below[~found], kinds[~found]
        symbols = self.kinds[0][0] if len(self.kinds[0]) else 0
        out[left] = escape / max(1, 256 - symbols)
        return out


def suffix_runs(runs: DataFrame, order: int) -> DataFrame:
    """Runs of order + 1 bytes and their counts, from longer ones."""
    return runs.groupBy(F.col("key").bitwiseAND(F.lit(_mask(order + 1))).alias("key")).agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Tables:
    """The whole trie above the whole orders, distributed: runs (key, n) and contexts (context, total, kinds, below) by order."""

    runs: dict[int, DataFrame]
    contexts: dict[int, DataFrame]

    @classmethod
    def of(cls, runs: DataFrame) -> Tables:
        by = {ORDER: runs}
        for order in range(ORDER - 1, WHOLE - 1, -1):
            by[order] = materialize(suffix_runs(by[order + 1], order), "lm-runs")
        contexts = {}
        for order in range(ORDER, WHOLE, -1):
            shorter = by[order - 1].select(F.col("key").alias("_suffix"), F.col("n").alias("_n"))
            both = by[order].join(shorter, F.col("key").bitwiseAND(F.lit(_mask(order))) == F.col("_suffix"))
            found = both.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("_n").alias("below"))
            contexts[order] = materialize(found, "lm-contexts")
        return cls(by, contexts)

    def frequent(self, max_runs: int) -> Trie:
        """The contexts that occur at least so often that each order has at most ``max_runs`` runs after them, and all of the whole orders."""
        least = 1
        for order in range(ORDER, WHOLE, -1):
            step = F.floor(4 * F.log2("total"))
            sizes = self.contexts[order].groupBy(step.alias("step")).agg(F.sum("kinds").alias("runs"), F.min("total").alias("least")).orderBy(F.desc("step")).collect()
            held, bound = 0, None
            for r in sizes:
                held += r["runs"]
                if held > max_runs:
                    break
                bound = r["least"]
            else:
                bound = 1
            least = max(least, bound if bound is not None else 2**62)
        runs = {WHOLE: _arrays(self.runs[WHOLE])}
        for order in range(ORDER, WHOLE, -1):
            kept = self.contexts[order].filter(F.col("total") >= least).select("context")
            runs[order] = _arrays(self.runs[order].join(kept, F.shiftright("key", 8) == F.col("context"), "left_semi"))
        return Trie(runs, complete=False)

    def logs(self, asked: DataFrame, lower: Callable[[], Trie]) -> DataFrame:
        """(key, log) of the asked runs (key): order by order in joins, then by the whole orders, which ``lower`` has."""
        zero = F.lit(0.0)
        rows = asked.select("key").distinct().select("key", F.lit(1.0).alias("escape"), zero.alias("below"), zero.alias("kinds"), F.lit(None).cast("double").alias("p"))
        for order in range(ORDER, WHOLE, -1):
            context = self.contexts[order].select("context", F.col("total").alias("_total"), F.col("kinds").alias("_kinds"), F.col("below").alias("_below"))
            run = self.runs[order].select(F.col("key").alias("_run"), F.col("n").alias("_n"))
            mine = F.col("key").bitwiseAND(F.lit(_mask(order + 1)))
            rows = rows.join(context, F.shiftright(mine, 8) == F.col("context"), "left").join(run, mine == F.col("_run"), "left")
            n, q, seen = F.col("_total") - F.col("below"), F.col("_kinds") - F.col("kinds"), F.col("context").isNotNull()
            free = seen & (n > 0)
            found = F.when(F.col("p").isNull() & F.col("_n").isNotNull() & free, F.col("escape") * F.col("_n") / (n + q))
            rows = rows.select(
                "key", F.when(free, F.col("escape") * q / (n + q)).otherwise(F.col("escape")).alias("escape"), F.when(seen, F.col("_below")).otherwise(F.col("below")).cast("double").alias("below"),
                F.when(seen, F.col("_kinds")).otherwise(F.col("kinds")).cast("double").alias("kinds"), F.coalesce("p", found).alias("p"),
            )

        def run_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = None
            for batch in batches:
                trie = trie or lower()
                key, escape, below, kinds, p = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                p = p.astype(np.float64)
                open_ = np.isnan(p)
                p = p.copy()
                p[open_] = trie.descend(key[open_].astype(np.uint64), escape[open_], below[open_], kinds[open_], WHOLE)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.log10(p))], names=["key", "log"])

        return map_batches(rows, run_down, "key long, log double", keeps=True)


def _arrays(runs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = runs.select("key", "n").toArrow()
    return table.column("key").to_numpy(), table.column("n").to_numpy()


# ------------------------------------------------------------------- on DataFrames


def score(docs: DataFrame, training: Column, *, max_runs: int = 3_000_000, max_frequent: int = 200_000) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score) of all rows.

    ``training``: which rows to learn from; a null answer is no. Tokens: words, ASCII
    lower-cased, and one end. base_score: add-one unigram log10 probability of the tokens.
    score: the byte model's log10 probability of the whole text with its end. Null texts
    are empty: one token. Rows without doc_id and rows that repeat one are scored, and
    learned from, one by one; other columns are ignored; an empty table gives no rows, and
    without training rows every byte is as likely as any other.

    The ``max_frequent`` most frequent words are looked up from a broadcast; all other
    words meet their counts in a join, none is left out. So do bytes after contexts that
    have no place among at most ``max_runs`` runs of each order.
    """
    spark = docs.sparkSession
    counts = materialize(corpus_counts(docs.filter(training)), "lm-counts", ["kind"])
    words = counts.filter(F.col("kind") == WORD_KIND).select("key", "n")
    facts = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    texts = counts.filter(F.col("kind") == SUM_KIND).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    total, distinct = facts["n"] + texts, facts["v"] + (1 if texts else 0)
    log_all = float(np.log10(total + distinct + 1))

    runs = counts.filter(F.col("kind") == RUN_KIND).select("key", "n")
    tables = None
    if runs.count() <= max_runs:
        model: Trie | tuple = _arrays(runs)  # workers build the trie from it
    else:
        tables = Tables.of(runs)
        model = tables.frequent(max_runs)
    table = above(words, max_frequent).toArrow()
    order = np.argsort(table.column("key").to_numpy())
    frequent = table.column("key").to_numpy()[order], table.column("n").to_numpy()[order]
    shared = spark.sparkContext.broadcast((model, *frequent))
    model_key = hash((spark.sparkContext.applicationId, shared._jbroadcast.id()))
    end_log = float(np.log10(texts + 1))
    schema = pa.schema(
        [("row_id", pa.int64()), ("doc_id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64())]
        + [("logs", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
        + [("runs", pa.list_(pa.int64())), ("run_times", pa.list_(pa.int32()))]
    )

    def trie_here() -> Trie:
        return keep_here(("trie", model_key), lambda: shared.value[0] if isinstance(shared.value[0], Trie) else Trie({ORDER: shared.value[0]}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, keys, times = shared.value
        trie, logs, hashed, row = trie_here(), np.log10(times + 1.0), WordHasher(), TaskContext.get().partitionId() << 36

        def scored(some: pa.RecordBatch, texts_here: list[bytes], first: int) -> pa.RecordBatch:
            n = len(texts_here)
            found, bounds = hashed.many([t.lower() for t in texts_here])
            found, size = found.view(np.int64), np.diff(bounds)
            owner = np.repeat(np.arange(n), size)
            at, hit = Trie._find(keys, found)
            sums = lambda who, what=None: np.bincount(who, what, n)
            known, mine = sums(owner[hit]).astype(np.int64) + (1 if texts else 0), sums(owner[hit], logs[at[hit]]) + end_log
            run_keys, begin = runs_of(texts_here)
            run_owner = np.repeat(np.arange(n), np.diff(begin, append=len(run_keys)))
            length, unknown = trie.logs(run_keys)
            columns = [
                pa.array(np.arange(first, first + n)), some.column(0), some.column(2), pa.array(size + 1), pa.array(known), pa.array(mine),
                pa.array(np.add.reduceat(length, begin)), *_listed(owner[~hit], found[~hit], n), *_listed(run_owner[unknown], run_keys[unknown].view(np.int64), n),
            ]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            start, waiting, held = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                waiting.append((text.as_py() or "").encode())
                held += len(waiting[-1])
                if held > _TOGETHER or len(waiting) == 512 or i == batch.num_rows - 1:
                    yield scored(batch.slice(start, len(waiting)), waiting, row)
                    row += len(waiting)
                    start, waiting, held = i + 1, [], 0

    looked = map_batches(
        docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training")), run,
        "row_id long, doc_id long, training boolean, n_tokens long, known long, logs double, score double, rare array<long>, times array<int>, runs array<long>, run_times array<int>",
        keeps=True,
    )
    looked = materialize(looked, "lm-scored")
    rare = looked.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("_w")).select(
        "row_id", F.col("_w.rare").alias("key"), F.col("_w.times").alias("_times")
    )
    met = rare.join(words, "key").groupBy("row_id").agg(
        F.sum("_times").alias("_known"), F.sum(F.col("_times") * F.log10(F.col("n") + F.lit(1.0))).alias("_logs")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = looked.select("row_id", "doc_id", "training", "n_tokens", "known", "logs", "score").join(met, "row_id", "left")
    length = F.col("score")
    if tables:
        asked = looked.select("row_id", F.explode(F.arrays_zip("runs", "run_times")).alias("_r")).select(
            "row_id", F.col("_r.runs").alias("key"), F.col("_r.run_times").alias("_times")
        )
        logs = tables.logs(asked, trie_here)
        lengths = asked.join(logs, "key").groupBy("row_id").agg(F.sum(F.col("_times") * F.col("log")).alias("_length"))
        out, length = out.join(lengths, "row_id", "left"), F.col("score") + zero("_length")
    return out.select(
        "doc_id", "training", "n_tokens", (F.col("known") + zero("_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("_logs") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), length.alias("score"),
    )


def _listed(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Each owner's distinct keys, and how often each occurs, as lists."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.zeros(0, dtype=np.int64)
    ends = pa.array(np.searchsorted(owner[first], np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(keys[first])), pa.ListArray.from_arrays(ends, pa.array(np.diff(first, append=len(keys)), pa.int32()))
