"""Toxicity scores from the nearest labelled examples by exact cosine of TF-IDF vectors.

Terms are lower-cased words, split at ASCII characters other than letters. All terms
of the drawn labelled examples count. A term's weight is its inverse document
frequency, of all documents: neighbours, their ranks and cosines are plain TF-IDF.

What is learned lies in the votes. A neighbour's vote grows exponentially with its
agreement: its cosine once more, with every term multiplied by one plus the chi-square by
which the term's presence goes with the label. The kernel's rate and the calibration are
fitted on the examples themselves, each scored without itself.

Neighbours come from a block-max inverted index: the short lists of rare terms are added
up, examples lie in blocks of similar ones, every common term has its largest weight in
each block, and a text visits only blocks whose bound reaches its k-th best cosine so
far. The k nearest are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, _small, give_back, map_batches, map_rows, materialize, release

_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
#: Texts whose cosines are found at once, their cosines with all examples at most, and examples of a block.
BATCH, PLACES, BLOCK = 256, 2_000_000, 64
#: Characters of texts whose words are looked up at once; each time Arrow hashes all terms.
CHARACTERS = 4_000_000
#: Products that are taken at once, so that neighbours of very long texts stay small in memory.
AT_ONCE = 500_000
#: Rates of the votes' kernel, of which training takes the best.
RATES = (2.0, 4.0, 8.0, 12.0, 16.0)


def _spaced(text: str | None) -> bytes:
    """The words of a text and spaces."""
    return (text or "").lower().encode().translate(_LETTERS)


def words_of(text: str | None) -> list[bytes]:
    return _spaced(text).split()


def batches_of(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, of several at most CHARACTERS together."""
    some, size = [], 0
    for text in texts:
        n = len(text or "")
        if some and size + n > CHARACTERS:
            yield some
            some, size = [], 0
        some.append(text)
        size += n
    if some:
        yield some


def words_at(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, the number of each one's text), by Arrow's kernels; beside spaces at a text's ends stands an empty word."""
    words = pc.ascii_split_whitespace(pa.array([_spaced(t) for t in texts], pa.binary()).cast(pa.string()))
    return words.values.cast(pa.binary()), np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(words.offsets.to_numpy()))


class TermCounter:
    """Counts the known terms of texts."""

    def __init__(self, terms: list[bytes] | pa.Array) -> None:
        self.terms = terms if isinstance(terms, pa.Array) else pa.array(terms, pa.binary())

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.terms.to_pylist())}

    def arrays(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the known terms in order, how often each occurs)."""
        counts = Counter(words_of(text))
        ids = np.fromiter(map(self.ids.get, counts, repeat(-1)), dtype=np.int64, count=len(counts))
        times = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
        order = np.argsort(ids)
        order = order[np.searchsorted(ids[order], 0) :]
        return ids[order], times[order]

    def pairs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, id, how often) of the known terms of texts, in order of both, by Arrow's kernels."""
        words, text = words_at(texts)
        ids = pc.index_in(words, self.terms)
        del words
        key = text[ids.is_valid().to_numpy(zero_copy_only=False)].astype(np.int64)
        key *= len(self.terms)
        key += ids.drop_null().to_numpy()
        del ids, text
        key.sort()
        first = _changes(key)
        return *np.divmod(key[first], max(1, len(self.terms))), np.diff(first, append=len(key))

    def many(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``arrays`` of each text."""
        text, ids, times = self.pairs(texts)
        edges = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        return [(ids[a:z], times[a:z]) for a, z in pairwise(edges)]

    def __call__(self, text: str | None) -> dict[int, int]:
        terms, times = self.arrays(text)
        return dict(zip(terms.tolist(), times.tolist(), strict=True))


def _changes(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range of n, one range after the other."""
    start, n = start.astype(np.int64), n.astype(np.int64)
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _pieces(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of places with about AT_ONCE of n together, a place at least."""
    ends, a = np.cumsum(n, dtype=np.int64), 0
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + AT_ONCE, side="right")))
        yield a, z
        a = z


class BlockMaxIndex:
    """Unit example vectors of positive weights, to find those of largest cosine.

    Terms that many examples have are rows of a dense matrix with each block's largest
    weight, others have lists of their examples. The lists of a text's terms are added up
    in double precision, once for all that is asked of them; with the blocks' largest
    weights they bound each block. A text visits the twelfth of the blocks with its largest
    bounds first, then all blocks whose bound reaches its k-th best cosine. Products with
    the dense rows add up in single precision; what by the bound of rounding errors may be
    among the k best is computed again in double precision, so the k nearest are exact.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK) -> None:
        self.size = len(rows)
        lengths = np.array([len(t) for t, _ in rows], dtype=np.int64)
        term = np.concatenate([t for t, _ in rows]).astype(np.int32) if rows else np.zeros(0, dtype=np.int32)
        weight = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
        held = np.bincount(term, minlength=terms)
        common = np.flatnonzero(held > max(4, self.size // 24))
        self.column = np.full(terms, -1, dtype=np.int32)
        self.column[common] = np.arange(len(common))
        self.order = self._similar(term, weight, lengths, len(common), block)  # example of each place
        first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        at = _ranges(first[self.order], lengths[self.order]) if self.size else np.zeros(0, dtype=np.int64)
        self.term, self.weight = term[at], weight[at]
        self.first = np.concatenate([[0], np.cumsum(lengths[self.order])]).astype(np.int64) if self.size else np.zeros(1, dtype=np.int64)
        self.terms, self.block = terms, block
        self._arrange()

    def __getstate__(self) -> tuple:
        """The lists and the common terms, which searches need: the vectors stay behind, the dense rows follow from these."""
        return self.terms, self.block, self.order, self.column, self.entry, self.owner, self.light, self.held, self.held_weight, self.held_first

    def __setstate__(self, state: tuple) -> None:
        self.terms, self.block, self.order, self.column, self.entry, self.owner, self.light, self.held, self.held_weight, self.held_first = state
        self.size = len(self.order)
        self._fill()

    def _fill(self) -> None:
        """The dense rows and the largest weights of the blocks."""
        self.edges = np.append(np.arange(0, self.size, self.block), self.size)
        self.blocks = len(self.edges) - 1
        common = int(self.column.max(initial=-1)) + 1
        self.dense = np.zeros((common, self.size), dtype=np.float32)
        self.dense[self.held, np.repeat(np.arange(self.size, dtype=np.int32), np.diff(self.held_first))] = self.held_weight
        self.dense_most = np.maximum.reduceat(self.dense, self.edges[:-1], axis=1) if self.size else np.zeros((common, 0), dtype=np.float32)
        self.visited = self.possible = 0

    def _arrange(self) -> None:
        """The lists, and the vectors' common terms."""
        terms = self.terms
        owner = np.repeat(np.arange(self.size), np.diff(self.first))
        column = self.column[self.term]
        rest = np.flatnonzero(column < 0)
        rest = rest[np.lexsort((owner[rest], self.term[rest]))]
        self.owner, self.light = owner[rest].astype(np.int32), self.weight[rest]
        self.entry = np.searchsorted(self.term[rest], np.arange(terms + 1)).astype(np.int32)  # where each term's list starts
        # The vectors' common terms once more, example by example, for sums in double precision.
        some = np.flatnonzero(column >= 0)
        self.held, self.held_weight = column[some], self.weight[some]
        self.held_first = np.concatenate([[0], np.cumsum(np.bincount(owner[some], minlength=self.size))]).astype(np.int64)
        self._fill()

    def resting(self) -> BlockMaxIndex:
        """The index as it is broadcast; it wakes where it is read."""
        for name in ("dense", "dense_most", "term", "weight", "first"):
            setattr(self, name, None)
        return self

    def _similar(self, term: np.ndarray, weight: np.ndarray, lengths: np.ndarray, columns: int, block: int) -> np.ndarray:
        """The examples in an order that puts similar ones together: halves by the main direction, again and again."""
        owner, column = np.repeat(np.arange(self.size), lengths), self.column[term]
        x = np.zeros((self.size, columns), dtype=np.float32)
        x[owner[column >= 0], column[column >= 0]] = weight[column >= 0]

        def split(some: np.ndarray) -> list[np.ndarray]:
            if len(some) <= block or not columns:
                return [some]
            part = x[some] - x[some].mean(axis=0)
            direction = part[np.abs(part).sum(axis=1).argmax()]
            for _ in range(8):
                direction = part.T @ (part @ direction)
                direction /= max(1e-30, np.sqrt((direction**2).sum()))
            half = -(-len(some) // (2 * block)) * block  # whole blocks on the left
            sides = some[np.argsort(part @ direction, kind="stable")]
            return split(sides[:half]) + split(sides[half:])

        return np.concatenate(split(np.arange(self.size))) if self.size else np.zeros(0, dtype=np.int64)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine, ties by number: (numbers, cosines)."""
        return self.all_nearest([(terms, weights)], k, [without])[0]

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each vector."""
        return [(numbers, cosines) for numbers, cosines, _ in self.all_products(vectors, [None] * len(vectors), k, without)]

    def all_products(
        self, vectors: list[tuple[np.ndarray, np.ndarray]], others: list[np.ndarray | None], k: int, without: list[int] | None = None
    ) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``nearest`` of each vector, and those examples' products with other weights of the vector's terms."""
        place = np.argsort(self.order) if without else None
        out, step = [], min(BATCH, max(1, PLACES // max(1, self.size)))
        for a in range(0, len(vectors), step):
            skip = [int(place[w]) if w >= 0 else -1 for w in without[a : a + step]] if without else None
            out += self._batch(vectors[a : a + step], others[a : a + step], k, skip)
        return out

    def _batch(self, some: list[tuple[np.ndarray, np.ndarray]], others: list[np.ndarray | None], k: int, skip: list[int] | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(some)
        if not self.size:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))] * n
        heavy = np.zeros((n, len(self.dense)), dtype=np.float32)
        rare = np.zeros((n, self.size))
        rare_others = np.zeros((n, self.size)) if any(o is not None for o in others) else rare
        for i, ((t, w), other) in enumerate(zip(some, others, strict=True)):
            c = self.column[t]
            heavy[i, c[c >= 0]] = w[c >= 0]
            light = c < 0
            self._lists(t[light], [(rare[i], w[light])] + ([(rare_others[i], other[light])] if other is not None else []))
        bound = heavy @ self.dense_most + np.maximum.reduceat(rare, self.edges[:-1], axis=1)
        slack = np.array([1 + (len(t) + 8) * 2.0**-22 for t, _ in some])  # all summands are positive
        sums = np.zeros((n, self.size), dtype=np.float32)
        mask = np.zeros((n, self.blocks), dtype=bool)
        best = np.argsort(-bound, axis=1, kind="stable")[:, : max(2, self.blocks // 12, -(-2 * k // self.block))]
        np.put_along_axis(mask, best, True, axis=1)
        self._visit(mask, heavy, rare, sums)
        if skip:
            for i, s in enumerate(skip):
                sums[i, s] = 0 if s >= 0 else sums[i, s]
        least = np.zeros(n)
        for i in range(n):
            seen = np.concatenate([sums[i, self.edges[b] : self.edges[b + 1]] for b in best[i]])
            least[i] = np.partition(seen, -k)[-k] if k < len(seen) else 0.0
        more = (bound * slack[:, None] * slack[:, None] >= least[:, None]) & (bound > 0) & ~mask
        self._visit(more, heavy, rare, sums)
        self.visited += int(mask.sum() + more.sum())
        self.possible += mask.size
        out, query = [], np.zeros((2, len(self.dense)))
        for i, ((t, w), other) in enumerate(zip(some, others, strict=True)):
            if skip and skip[i] >= 0:
                sums[i, skip[i]] = 0
            places = self._candidates(sums[i], k, slack[i] * slack[i], float(least[i]))
            c = self.column[t]
            query[0, c[c >= 0]] = w[c >= 0]
            if other is not None:
                query[1, c[c >= 0]] = other[c >= 0]
            cosines, products = self._common(places, query)
            query[:, c[c >= 0]] = 0
            cosines += rare[i, places]
            numbers = self.order[places]
            first = np.lexsort((numbers, -cosines.round(12)))[:k]
            out.append((numbers[first], cosines[first], (products + rare_others[i, places])[first]))
        return out

    def _lists(self, terms: np.ndarray, sums: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Add to each of ``sums`` the lists of ``terms`` by its weights, about AT_ONCE postings at a time."""
        start = self.entry[terms]
        n = self.entry[terms + 1] - start
        for a, z in _pieces(n):
            at = _ranges(start[a:z], n[a:z])
            owner, light = self.owner[at].astype(np.intp), self.light[at]
            for total, weights in sums:
                total += np.bincount(owner, light * np.repeat(weights[a:z], n[a:z]), minlength=self.size)

    def _visit(self, mask: np.ndarray, heavy: np.ndarray, rare: np.ndarray, sums: np.ndarray) -> None:
        """Set the cosines of the masked (text, block) places in ``sums``."""
        for b in np.flatnonzero(mask.any(axis=0)).tolist():
            rows, a, z = np.flatnonzero(mask[:, b]), self.edges[b], self.edges[b + 1]
            sums[rows, a:z] = heavy[rows] @ self.dense[:, a:z] + rare[rows, a:z]

    def _candidates(self, near: np.ndarray, k: int, slack: float, floor: float) -> np.ndarray:
        """Places of all that may be among the k nearest, by cosines with rounding errors."""
        places = np.flatnonzero(near * slack >= floor) if floor > 0 else np.flatnonzero(near > 0)
        if len(places) > k:
            places = places[near[places] * slack >= np.partition(near[places], -k)[-k]]
        return places

    def _common(self, places: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Products of the common terms of the vectors at ``places`` and each query, about AT_ONCE at a time."""
        first, last = self.held_first[places], self.held_first[places + 1]
        out = np.zeros((len(queries), len(places)))
        some = np.flatnonzero(last > first)
        first, last = first[some], last[some]
        for a, z in _pieces(last - first):
            ranges = list(zip(first[a:z].tolist(), last[a:z].tolist(), strict=True))
            column, weight = (np.concatenate([x[f:l] for f, l in ranges]) for x in (self.held, self.held_weight))
            starts = np.cumsum(last[a:z] - first[a:z]) - (last[a:z] - first[a:z])
            for total, query in zip(out, queries, strict=True):
                total[some[a:z]] = np.add.reduceat(query[column] * weight, starts)
        return out

    def lengths(self, strength: np.ndarray) -> np.ndarray:
        """Length of every example's vector once its terms are multiplied by ``strength``."""
        squares = np.add.reduceat((self.weight * strength[self.term]) ** 2, self.first[:-1]) if self.size else np.zeros(0)
        out = np.zeros(self.size)
        out[self.order] = np.sqrt(squares)
        return out


@dataclass
class ToxicityModel:
    terms: list[bytes]
    weight: np.ndarray  # of a term: its inverse document frequency
    ids: np.ndarray  # of the examples
    labels: np.ndarray
    votes: np.ndarray  # an example's weight, so that drawn classes count as in all labelled rows
    index: BlockMaxIndex | None
    prior: float  # share of label 1 among labelled rows without any term
    k: int
    strength: np.ndarray | None = None  # of a term: one plus its chi-square
    norms: np.ndarray | None = None  # of the examples, their terms multiplied by their strength
    rate: float = 8.0
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), dtype=np.int64)
        return self.unit(terms, np.array([counts[t] for t in terms.tolist()], dtype=np.int64))

    def unit(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A vector of length 1 of terms in order and how often each occurs."""
        weight = (1 + np.log(times)) * self.weight[terms]
        return terms, weight / np.sqrt((weight**2).sum()) if len(weight) else weight

    def stressed(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weights of the terms whose products with examples, over ``norms``, are cosines with all terms multiplied by their strength."""
        strong = weights * self.strength[terms]
        return strong * self.strength[terms] / np.sqrt((strong**2).sum()) if len(strong) else strong

    def neighbours(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers, cosines, agreement) of the nearest examples of each unit vector."""
        found = self.index.all_products(vectors, [self.stressed(*v) for v in vectors], self.k, without)
        return [(numbers, cosines, products / self.norms[numbers]) for numbers, cosines, products in found]

    def raw(self, numbers: np.ndarray, agreement: np.ndarray) -> float:
        """Votes weighted by agreement, with the prior as a vote without any."""
        vote, one = self.votes[numbers] * np.exp(self.rate * agreement), self.votes.mean()
        return float(((vote * self.labels[numbers]).sum() + self.prior * one) / (vote.sum() + one))

    def calibrated(self, raw: float) -> float:
        p = min(1 - 1e-6, max(1e-6, raw))
        return float(1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift))))


def _platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit on log odds, by Newton steps with a small ridge towards 1 and 0."""
    x = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / (1 - np.clip(raw, 1e-6, 1 - 1e-6)))
    both, beta = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    weight = weight / max(1e-12, weight.sum()) * len(weight)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(both @ beta, -30, 30)))
        gradient = both.T @ (weight * (p - y)) + 1.0 * (beta - np.array([1.0, 0.0]))
        hessian = (both * (weight * p * (1 - p))[:, None]).T @ both + 1.0 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(0.05, beta[0])), float(beta[1])


def train(
    docs: DataFrame, labels: DataFrame, training: Column, *, max_examples: int = 3000, k: int = 60, seed: int = 3
) -> ToxicityModel:
    """Learn from at most about ``max_examples`` labelled rows of each label, drawn by seeded hashes.

    All their terms count. Chi-square, of terms that five examples have or more, weighs
    the votes of neighbours and never chooses them. Null labels and rows outside ``training`` are skipped; of
    a doc_id labelled twice the larger label counts, and of equal rows of ``docs`` one
    is an example. ``docs`` needs doc_id and text, ``labels`` doc_id and toxic; other
    columns are ignored. Without labelled rows every score is the same. Document
    frequencies are of all ``docs``.
    """
    spark = docs.sparkSession
    known = labels.filter(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = _of_labels(known)

    def drawn(rows: DataFrame, sizes: dict[int, int], *key: str) -> DataFrame:
        limit = F.lit(0)
        for label, n in sizes.items():
            limit = F.when(F.col("toxic") == label, F.lit(int(1_000_000 * min(1.0, max_examples / n)))).otherwise(limit)
        return rows.filter(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_000)) < limit)

    ids = materialize(drawn(known, counts, "doc_id"), "toxic-drawn")
    few = ids.count() <= 4 * max_examples  # by the draw about 2 * max_examples rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id").dropDuplicates(["doc_id", "text"])
    found = materialize(rows, "toxic-found")
    sizes = _of_labels(found)
    sample = found
    if max(sizes.values(), default=0) > 1.1 * max_examples:  # several texts of one doc_id: rows are drawn once more
        sample = materialize(drawn(found, sizes, "doc_id", "text"), "toxic-examples")
        sizes = _of_labels(sample)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, at = batch.column(1).to_numpy(), 0
            for texts in batches_of(batch.column(0).to_pylist()):
                words, text = words_at(texts)
                words = words.dictionary_encode()
                every = len(words.dictionary)
                key = text.astype(np.int64) * every + words.indices.to_numpy()
                key.sort()
                text, term = np.divmod(key[_changes(key)], max(1, every))
                of = label[at + text]
                at += len(texts)
                rows = [words.dictionary, *(pa.array(np.bincount(term[of == y], minlength=every)) for y in (0, 1))]
                yield pa.RecordBatch.from_arrays(rows, names=["term", "n0", "n1"]).filter(pc.not_equal(words.dictionary, b""))

    all0, all1 = sizes.get(0, 0), sizes.get(1, 0)
    held = map_batches(sample.select("text", "toxic"), spread, "term binary, n0 long, n1 long")
    held = held.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    total = float(all0 + all1)
    cross = a * (all0 - b) - b * (all1 - a)
    chi2 = F.try_divide(total * cross * cross, F.lit(float(all1)) * all0 * (a + b) * (total - a - b))
    table = held.select("term", (a + b).alias("n"), F.when(a + b >= 5, F.coalesce(chi2, F.lit(0.0))).otherwise(0.0).alias("chi2")).toArrow()
    table = table.sort_by([("n", "descending"), ("term", "ascending")])  # so that what most lookups meet lies together in memory
    terms, strength = pa.concat_arrays([pa.array([], pa.binary()), *table.column("term").chunks]), 1 + table.column("chi2").to_numpy().copy()
    del table
    shared = spark.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TermCounter(shared.value)
        n = np.zeros(len(count.terms) + 1, dtype=np.int64)
        for batch in batches:
            n[-1] += batch.num_rows
            for piece in _small(batch) if batch.num_rows else ():
                for texts in batches_of(piece.column(0).to_pylist()):
                    n[:-1] += np.bincount(count.pairs(texts)[1], minlength=len(count.terms))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

    df = np.zeros(len(terms) + 1)
    seen = map_batches(docs.select("text"), frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[seen.column("term").to_numpy()] = seen.column("n").to_numpy()
    del seen
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def bags():
        count = TermCounter(shared.value)

        def work(c):
            found = [bag for texts in batches_of(c["text"]) for bag in count.many(texts)]
            return {"doc_id": c["doc_id"], "toxic": c["toxic"], "terms": [t for t, _ in found], "times": [n for _, n in found]}

        return work

    bagged = map_rows(sample, bags, "doc_id long, toxic int, terms array<int>, times array<int>").toArrow()
    columns = (bagged.column(name) for name in ("doc_id", "toxic", "terms", "times"))
    rows = [(i.as_py(), y.as_py(), t.values.to_numpy().astype(np.int32), n.values.to_numpy().astype(np.int32)) for i, y, t, n in zip(*columns, strict=True)]
    del bagged, columns
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
    shared.unpersist()
    release(ids, found, sample)
    give_back()
    model = _fit(rows, terms.to_pylist(), idf, strength, counts, (all0, all1), k)
    del rows
    give_back()
    return model


def _of_labels(rows: DataFrame) -> dict[int, int]:
    """Number of rows of each label."""
    return {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}


def _fit(rows: list, terms: list[bytes], weight: np.ndarray, strength: np.ndarray, counts: dict, sizes: tuple[int, int], k: int) -> ToxicityModel:
    share = [counts.get(c, 0) / max(1, sizes[c]) for c in (0, 1)]
    positive = counts.get(1, 0)
    empty = [sum(share[y] for _, y, bag, _ in rows if not len(bag) and y == c) for c in (0, 1)]
    prior = (empty[1] + 0.01 * positive / max(1, sum(counts.values()))) / (sum(empty) + 0.01) if rows else positive / max(1, sum(counts.values()))
    used = [r for r in rows if len(r[2])]
    model = ToxicityModel(
        terms, weight, np.array([r[0] for r in used], dtype=np.int64), np.array([r[1] for r in used], dtype=float),
        np.array([share[r[1]] for r in used], dtype=float) if used else np.ones(1), None, prior, k, strength,
    )
    vectors = [model.unit(r[2], r[3]) for r in used]
    model.index = BlockMaxIndex(vectors, len(terms))
    model.norms = model.index.lengths(strength)
    near = [(numbers, agreement) for numbers, _, agreement in model.neighbours(vectors, list(range(len(used))))]
    model.index.resting()
    blank = [r for r in rows if not len(r[2])]
    y = np.array([r[1] for r in used + blank], dtype=float)
    if not len(y):
        return model
    times, least = np.array([share[int(v)] for v in y]), np.inf
    for rate in RATES:
        model.rate = rate
        raw = np.array([model.raw(*f) for f in near] + [prior] * len(blank))
        slope, shift = _platt(raw, y, times)
        odds = slope * np.log(np.clip(raw, 1e-6, 1 - 1e-6) / (1 - np.clip(raw, 1e-6, 1 - 1e-6))) + shift
        loss = float((times * np.logaddexp(0, np.where(y > 0, -odds, odds))).sum())
        if loss < least:
            least, best = loss, (rate, slope, shift)
    model.rate, model.slope, model.shift = best
    return model


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = (), *, evidence: bool = True) -> DataFrame:
    """(doc_id, *keep, score, predicted, neighbours, cosines) of every row.

    score: calibrated chance of label 1, 0 to 1; predicted: 1 if score >= 0.5.
    neighbours and cosines are the evidence: the nearest examples' doc_ids, nearest
    first; without ``evidence`` they are worked out and left out. Texts of any length are read whole; a text takes a task its words' worth of memory. Texts that are null, empty or without known terms have no neighbours and
    get the score of labelled rows that have none either. Repeated rows are scored
    one by one. An empty table gives no rows. Columns besides doc_id, text and those
    of ``keep`` are ignored; ``keep`` may not name an output.
    """
    if clash := {"score", "predicted", "neighbours", "cosines"} & set(keep):
        raise ValueError(f"columns to keep have names of outputs: {sorted(clash)}")
    spark, types = docs.sparkSession, dict(docs.dtypes)
    shared = spark.sparkContext.broadcast(replace(model, terms=pa.array(model.terms, pa.binary())))  # a task holds terms in one piece
    held = list(dict.fromkeys(["doc_id", *keep]))
    columns = list(dict.fromkeys([*held, "text"]))
    schema = ", ".join([f"`{c}` {types[c]}" for c in held] + ["score double"] + ["neighbours array<long>", "cosines array<double>"] * evidence)
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        count = TermCounter(model.terms)
        blank = model.calibrated(model.prior)
        for batch in batches:
            for piece in _small(batch) if batch.num_rows else ():
                scores, near, far = [], [], []
                for texts in batches_of(piece.column(columns.index("text")).to_pylist()):
                    vectors = [model.unit(*bag) for bag in count.many(texts)]
                    pa.default_memory_pool().release_unused()  # what the words took, before the search takes its own
                    for numbers, cosines, agree in model.neighbours(vectors):
                        scores.append(model.calibrated(model.raw(numbers, agree)) if len(numbers) else blank)
                        if evidence:
                            near.append(model.ids[numbers])
                            far.append(cosines)
                out = {c: piece.column(i) for i, c in enumerate(held)} | {"score": scores} | ({"neighbours": near, "cosines": far} if evidence else {})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    scored = map_batches(docs.select(*columns), run, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
