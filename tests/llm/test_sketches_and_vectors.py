"""Order sketches, whitening and centroid clustering against brute force, on odd rows and on nothing."""

import math
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pathloom.llm import centroids, order_sketch, whitening

from .test_corpus import ODD, empty, sentences, table


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chain(values, width=8):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(width, "little", signed=True), seed=seed)
    return seed


def brute_fingerprint(text, k=3):
    """Order sketches by sorting all numbered k-mers of a text in each order."""
    symbols = [s.encode() for s in re.findall("[^\x20\x09-\x0d]{1,12}", text or "")]
    runs = [symbols[i : i + k] for i in range(max(1, len(symbols) - k + 1))] if symbols else []
    seen, kmers = Counter(), []
    for place, run in enumerate(runs):
        short = signed((chain(run) << 31) % 2**64) >> 31  # 33 bits, signed
        seed = xxhash.xxh64_intdigest(short.to_bytes(8, "little", signed=True), seed=42)
        kmers.append((signed(xxhash.xxh64_intdigest(seen[short].to_bytes(4, "little"), seed=seed)), place))
        seen[short] += 1
    out = []
    for part in range(order_sketch.PARTS):
        mine = [(h, p) for h, p in kmers if h % order_sketch.PARTS == part]
        for i in range(order_sketch.ORDERS):
            if not mine:
                out.append("-" * 8)
                continue
            turn = (i + 1) * 0x1E3779B97F4A7C15 % 2**63
            ordered = sorted((signed((chain([h ^ turn]) << 31) % 2**64 | p), p) for h, p in mine)
            ends = sorted((ordered[0], ordered[-1]), key=lambda e: e[1])
            out.append(f"{chain([e[0] >> 31 for e in ends]) >> 32:08x}")
    return "".join(out)


def brute_likeness(a, b):
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    have = [p for p in pairs if p != ("-" * 8,) * 2]
    return sum(x == y for x, y in have) / len(have) if have else 1.0


LONG = (9_000, "Ωmega " + " ".join(f"w{i % 700}" for i in range(20_000)))
NEIGHBOURS = [*ODD, (5000, "one two three four five six seven eight"), (5001, "one two three four five six seven eight"), (5002, "x" * 5000), (5003, "漢字" * 900), LONG]


def test_edited_neighbours_equal_brute_force(spark):
    docs = table(spark, [r for r in NEIGHBOURS if r != (7, "one")] + [(7, "one")])
    ordered = sorted(((i, t or "") for i, t in NEIGHBOURS if (i, t) != (7, "one")), key=lambda r: (r[0] is not None, r[0] or 0))
    at = next(n for n, r in enumerate(ordered) if r[0] and r[0] > 7)
    ordered.insert(at, (7, "one"))
    want = {}
    for n, (i, text) in enumerate(ordered):
        after, cut = ordered[(n + 1) % len(ordered)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        prints = [brute_fingerprint(t) for t in (text, edited, after)]
        want[i] = (len(text), sha256(edited.encode()).hexdigest(), prints[0], prints[1], brute_likeness(*prints[:2]), brute_likeness(prints[0], prints[2]))
    for rows in (200, 2):  # in one bucket, and in many
        got = {r["doc_id"]: tuple(r)[1:] for r in order_sketch.edited_neighbours(docs, bucket_rows=rows).collect()}
        assert got == want
    assert want[5000][5] == 1.0 and want[5000][2] == want[5001][2] and 0 < want[9_000][4] < 1


def test_repeated_rows_and_a_sole_document(spark):
    docs = spark.createDataFrame([(7, "one two three four")] * 5 + [(None, None), (7, "none of it")], "doc_id long, text string")
    got = order_sketch.edited_neighbours(docs, bucket_rows=1).collect()
    assert len(got) == 7 and Counter(r["near_next"] for r in got)[1.0] >= 4
    sole = order_sketch.edited_neighbours(docs.filter("doc_id is null")).collect()
    assert [tuple(r)[:3] for r in sole] == [(None, 0, sha256(b"").hexdigest())] and sole[0]["near_next"] == 1.0
    assert order_sketch.edited_neighbours(empty(spark)).count() == 0


def test_fingerprints_follow_order_and_edits(spark):
    words = sentences(5, 1, [f"{a}{b}" for a in "abcdefgh" for b in ("en", "un", "ta")], [])[0].split() + [f"q{i}" for i in range(400)]
    halves = words[200:] + words[:200]
    few = [w if i % 100 else "other" for i, w in enumerate(words)]
    texts = {1: words, 2: list(words), 3: few, 4: halves, 5: [f"z{i}" for i in range(300)]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("part", F.lit("x"))
    got = {r["doc_id"]: r["fingerprint"] for r in order_sketch.fingerprints(docs).collect()}
    near = {i: brute_likeness(got[1], got[i]) for i in got}
    assert near[2] == 1.0 and near[3] > 0.6 and near[4] < near[3] and near[5] == 0
    assert near[4] < 0.8  # nearly the same k-mers, in another order
    assert got[3] == brute_fingerprint(" ".join(few))


def test_order_sketches_run_no_python(spark):
    plan = order_sketch.edited_neighbours(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert order_sketch.sketches(table(spark).withColumn("_k", F.spark_partition_id()), ["_k", "doc_id"], ["text"]).columns == ["_k", "doc_id", "text"]


# ---------------------------------------------------------------- whitening


def brute_whitening(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, s, values[::-1], vectors[:, ::-1]


def check_whitening(rows, got, k=4, rel=1e-8):
    x = np.floor(256 * np.array([v for _, v in rows], dtype=float)).astype(np.int64)
    n, s, values, vectors = brute_whitening(x)
    k = min(k, int((values > 1e-9 * values[0]).sum()))
    assert Counter(r["vec_id"] for r in got) == Counter({i: c * k for i, c in Counter(i for i, _ in rows).items()})
    scores = (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k])
    deviation = Counter((i, int(d)) for (i, _), d in zip(rows, ((n * x - s) ** 2).sum(axis=1), strict=True))
    for c in range(1, k + 1):
        mine = [r for r in got if r["component"] == c]
        assert Counter((r["vec_id"], r["deviation"]) for r in mine) == deviation and {r["n"] for r in mine} == {n}
        ours, theirs = (sorted(zip(m, v, strict=True), key=lambda p: (p[0] is None, p)) for m, v in (([r["vec_id"] for r in mine], [r["whitened"] for r in mine]), ([i for i, _ in rows], scores[:, c - 1])))
        flipped = sorted(((i, -v) for i, v in theirs), key=lambda p: (p[0] is None, p))
        apart = min(max(abs(a[1] - b[1]) for a, b in zip(ours, other, strict=True)) for other in (theirs, flipped))
        assert apart < rel * 1e3, (c, apart)
        assert all(math.isclose(r["explained"], values[c - 1] / values.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9 for r in mine)


def embedded(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"x": F.lit(1), "n": F.lit("n"), "dim": F.lit(2), "cluster": F.lit(0)})


@pytest.mark.parametrize("flat", [False, True])
def test_whitening_equals_eigenvectors(spark, flat):
    draw = np.random.default_rng(3)
    scale = np.ones(40) * 0.3 + np.arange(40) * 0.002 if flat else 2.0 ** -np.arange(40)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(600, 40)) * scale)]
    rows += [(i, rows[7][1]) for i in range(900, 1100)] + [(7, rows[7][1]), (None, rows[8][1])]  # copies count once in the fit
    odd = [(2000, None), (2001, [math.nan] * 40), (2002, [1.0, None]), (2003, []), (2004, [math.inf] + [0.0] * 39)]
    check_whitening(rows, whitening.whiten(embedded(spark, rows + odd)).collect())


def test_passes_end_or_expand(spark):
    draw = np.random.default_rng(4)
    ints = lambda scale: spark.createDataFrame([(v.tolist(),) for v in np.floor(256 * draw.normal(size=(500, 48)) * scale).astype(int)], "x array<long>")
    steep = whitening.fit(ints(np.where(np.arange(48) < 4, 8.0 - np.arange(48), 0.02)), 48)
    assert not steep.expanded and 1 < steep.passes <= 6
    flat = whitening.fit(ints(np.ones(48)), 48)
    assert flat.expanded and flat.passes == 7


def test_whitening_of_little_and_of_huge(spark):
    few = [(i, v) for i, v in enumerate([[0.0, 1.0], [0.5, 1.0], [0.25, 1.0], [0.5, 1.0]])]  # varies in one dimension alone
    check_whitening(few, whitening.whiten(embedded(spark, few)).collect())
    assert whitening.whiten(embedded(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [2.0])])).count() == 0
    assert whitening.whiten(embedded(spark, few).filter("false")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    huge = whitening.whiten(embedded(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).collect()
    assert huge and all(r["deviation"] is None for r in huge if r["vec_id"] != 3)
    lengths = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(30, 3)))]
    more = [(100 + i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).normal(size=(20, 6)))]
    got = whitening.whiten(embedded(spark, lengths + more)).collect()
    check_whitening(lengths, [r for r in got if r["vec_id"] < 100])
    check_whitening(more, [r for r in got if r["vec_id"] >= 100])


# ---------------------------------------------------------------- centroids


def brute_clusters(rows, k, dim, rounds=3):
    x = {n: np.floor(64 * np.array(v)).astype(object) for n, (_, v) in enumerate(rows)}
    first = sorted((sha256(f"1:{i}".encode()).hexdigest(), tuple(x[n]), n) for n, (i, _) in enumerate(rows) if i is not None)[:k]
    centres = [x[n] for *_, n in first]
    nearest = lambda v: min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for v in x.values():
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [sum(groups[j]) // len(groups[j]) if j in groups else c for j, c in enumerate(centres)]
    found = {n: nearest(v) for n, v in x.items()}
    inertia = Counter()
    for d, j in found.values():
        inertia[j] += d
    digest = [sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centres]
    return Counter((rows[n][0], j, d, inertia[j], sum(inertia.values()), digest[j]) for n, (d, j) in found.items())


def clusters(found):
    return Counter(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in found.collect())


def test_clusters_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    middles = draw.normal(size=(9, 8)) * 3
    rows = [(i, (middles[i % 9] + draw.normal(size=8) * 0.2).tolist()) for i in range(500)]
    rows += [(600 + i, rows[3][1]) for i in range(250)] + [(None, rows[4][1]), (3, rows[3][1])]
    odd = [(900, None), (901, [1.0] * 7), (902, [math.nan] * 8), (903, [*[0.0] * 7, None]), (904, [])]
    found = centroids.cluster(embedded(spark, rows + odd), k=24, dim=8)
    assert clusters(found) == brute_clusters(rows, 24, 8)
    assert found.agg(F.avg("scanned")).first()[0] < 12  # of 24 centroids


def test_ties_go_to_the_smaller_number(spark):
    grid = [(i, [a / 64, b / 64, 0.0]) for i, (a, b) in enumerate((a, b) for a in range(-9, 10, 3) for b in range(-9, 10, 3))]
    for k in (1, 2, 16, 100):
        assert clusters(centroids.cluster(embedded(spark, grid), k=k, dim=3)) == brute_clusters(grid, k, 3)


def test_few_and_large_vectors(spark):
    same = [(i, [0.5, 0.25]) for i in range(6)]
    assert clusters(centroids.cluster(embedded(spark, same), k=3, dim=2)) == brute_clusters(same, 3, 2)
    large = [(i, [float(v) for v in r]) for i, r in enumerate(np.random.default_rng(6).integers(-2_000_000, 2_000_000, size=(40, 2)))]
    assert clusters(centroids.cluster(embedded(spark, large), k=5, dim=2)) == brute_clusters(large, 5, 2)
    assert centroids.cluster(embedded(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0])]), k=2, dim=2).count() == 2
    assert centroids.cluster(embedded(spark, [(None, [1.0, 0.0])]), dim=2).count() == 0
    assert centroids.cluster(embedded(spark, same)).columns[0] == "vec_id"


def test_search_with_any_valid_bounds_finds_the_nearest():
    draw = np.random.default_rng(8)
    x, at = draw.integers(-20, 20, size=(400, 3)), draw.integers(-20, 20, size=(30, 3))
    exact = centroids.squares(x, at)
    for _ in range(5):
        held = draw.integers(0, 30, size=400)
        own = np.sqrt(exact[np.arange(400), held])
        others = np.sqrt(np.where(np.arange(30) == held[:, None], 10**9, exact).min(axis=1))
        got = centroids.assign(x, centroids.Centres.of(at), held, own + draw.random(400) * 3, others * draw.random(400))
        assert (got[0] == exact.argmin(axis=1)).all() and (got[3] == exact.min(axis=1)).all()
        rest = np.sqrt(np.where(np.arange(30) == got[0][:, None], 10**9, exact).min(axis=1))
        assert (got[1] >= np.sqrt(got[3])).all() and (got[2] <= rest + 1e-9).all()
