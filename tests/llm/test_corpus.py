"""Corpus operators against brute force, and on nulls, empty tables, ties, repeated rows and clashing columns."""

import math
import pickle
import random
import time
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pathloom.llm import (
    binary,
    components,
    cuckoo,
    embedding_dedup,
    language_id,
    language_model,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    quality,
    tokens,
    toxicity,
)
from pathloom.llm.common import WordHasher, shingle_sets, shingles
from pathloom.llm.queries import vocabulary

ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, " \t\n"), (5, "Alpha beta gamma delta epsilon zeta eta theta"),
    (6, "word " * 30_000), (7, "one"), (7, "one"), (None, "no id at all here"), (8, "éà 漢字 😀 İ"), (9, "A longer line of text\nA longer line of text\n\nshort"),
    (10, "a longer LINE of text \nother words here"), (11, "x\x00y\x85z"),
]
SCHEMA = "doc_id long, text string"


def table(spark, rows=ODD, parts=3):
    """Documents with extra columns whose names clash with the operators' own."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    extra = {c: F.lit(i) for i, c in enumerate(("score", "kept", "n", "size", "key", "bands", "sequence_id", "shard", "predicted", "_drops", "n_words", "rank", "target"))}
    return docs.withColumns(extra).withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("s"), F.col("doc_id") % 3))).withColumn(
        "lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")
    )


def empty(spark):
    return table(spark).filter("false")


def words(text):
    return (text or "").encode().lower().split()


# ------------------------------------------------------------- tokens, packing, files


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def true_ids(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids + [1]


def test_tokenizer_equals_the_library(whole):
    mine = tokens.WordTokenizer(tokens.read_vocabulary(vocabulary()), cache_size=300)
    draw = random.Random(5)
    letters = [chr(c) for c in [*range(32, 127), *range(161, 592), 0, 9, 10, 11, 13, 0x1C, 0x85, 0xA0, 0x300, 0x3A3, 0x4E00, 0xB2]] + ["'s", "'RE", " ", "</w>", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == true_ids(whole, text), repr(text)


def test_packing_tiles_every_document(spark, whole):
    docs = table(spark)
    got = packing.pack(docs, vocabulary(), length=64, open_windows=4, merge_partitions=2, slack=2).collect()
    left = Counter((i, tuple(true_ids(whole, t))) for i, t in ODD)
    pieces, windows = {}, {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(n * len(ids) for (_, ids), n in left.items())
    for (doc_id, total), mine in pieces.items():
        if doc_id != 7:
            ids = b"".join(bytes(r["ids"]) for r in sorted(mine, key=lambda r: r["start"]))
            assert (doc_id, tuple(np.frombuffer(ids, "<u4").tolist())) in left and len(ids) == 4 * total
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.padded_share(packing.pack(docs, vocabulary(), length=64), 64).first()["padding"] < 0.05
    assert packing.sequences(packing.pack(docs, vocabulary(), length=64)).count() > 0
    assert packing.pack(empty(spark), vocabulary()).count() == 0


def test_binary_round_trip(spark, whole, tmp_path):
    path = f"file://{tmp_path}/b"
    binary.write(table(spark), path, vocabulary(), files=3)
    got = sorted(((r["start"], r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in binary.read(spark, path).collect()))
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (start, doc_id, ids), (want, text) in zip(got, ordered, strict=True):
        assert (start, doc_id, list(ids)) == (at, want, true_ids(whole, text))
        at += len(ids)
    some = binary.index(spark, path).filter("doc_id in (6, 9)")
    assert {r["doc_id"] for r in binary.read(spark, path, some).collect()} == {6, 9}
    binary.write(empty(spark), f"{path}-none", vocabulary())
    assert binary.read(spark, f"{path}-none").count() == 0


def test_damage_is_found():
    good = binary.frame(3, np.arange(50, dtype=np.uint32), False) + binary.END
    assert [d for _, d, _, _ in binary.frames_in(good + binary.frame(None, np.arange(2), True) + binary.END)] == [3, None]
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            list(binary.frames_in(bytes(bad)))


# --------------------------------------------------------------------- near duplicates


def brute_sets(rows, k):
    out = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            out.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(ids)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def family_rows(seed=3):
    """Families of texts at many similarities, with copies, and unrelated texts."""
    draw = random.Random(seed)
    rows, n = list(ODD), 100
    for _ in range(12):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(6, 80))]
        for _ in range(9):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 8))):
                text[draw.randrange(len(text))] = f"v{draw.randint(0, 99)}"
            rows.append((n, " ".join(text)))
            n += 1
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = family_rows()
    sets = brute_sets(rows, k)

    def linked(a, b):
        return any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])

    expected = brute_components(sets, linked)
    for r in near_dedup.near_duplicates(table(spark, rows), words=k).collect():
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert r["component_id"] == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_blocks_settle_what_leaders_leave(spark, monkeypatch):
    """A large group of variants, some just not alike enough, with every comparison but the first left to blocks."""
    for name, value in (("_SMALL", 1), ("_BLOCK", 1200), ("_FEW_PAIRS", 0), ("_HOT_PAIRS", 3)):  # hot classes are split, too
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(components, "FEW_EDGES", 10)
    draw = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(draw.randint(0, 9)):
            text[draw.randrange(80)] = f"v{draw.randint(0, 9)}"
        rows.append((i, " ".join(text)))
    sets = {i: s[0] for i, s in brute_sets(rows, 2).items()}
    expected = brute_components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = near_dedup.near_duplicates(table(spark, rows), words=2, leader_rounds=0).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected and len(set(expected.values())) > 1


def test_leaders_alone_do_not_decide(spark):
    """A chain of texts, each like the next: all are one component although few are like its first."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join([f"n{j}" if j < i else w for j, w in enumerate(base)])))
    got = near_dedup.near_duplicates(table(spark, rows), words=1).collect()
    assert {r["component_id"] for r in got} == {0}


def test_sketch_estimates_similarity():
    draw = np.random.default_rng(1)
    for n, common in ((1, 1), (40, 20), (3000, 1500)):
        pool = draw.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - common : 2 * n - common])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        one, two = near_dedup.sketch(a, 800), near_dedup.sketch(b, 800)
        assert (one != np.uint64(2**64 - 1)).all() and abs((one == two).mean() - truth) < 0.07


def thue_morse(n):
    """Two words of 2**n letters whose polynomial hashes modulo 2**64 are equal for every odd base, from n = 10 on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_made_to_collide_do_not(spark):
    one, two = thue_morse(10)
    long = "x" * 10_000
    rows = [(1, f"{one} b c"), (2, f"{two} b c"), (3, f"{one} {two} {one} {one} {two} {two}"), (4, f"{long}a {long}b {long}a"), (5, f"{long}a {long}b {long}a")]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(table(spark, rows), words=2).collect()}
    assert [got[i]["component_id"] for i in range(1, 6)] == [1, 2, 3, 4, 4] and [got[i]["n_shingles"] for i in range(1, 6)] == [2, 2, 4, 2, 2]
    counts, _ = quality.Statistics()(f"{one} {two} {one} x {two} {one} {two} y")
    assert counts[0] == 8 and counts[4] == 0
    assert len({int(x) for t in (6, 7, 10, 11) for x in WordHasher()(" ".join(thue_morse(t)).encode())}) == 8
    scored = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame([(0, f"{one} u"), (1, f"{two} u")], SCHEMA), F.col("doc_id") == 0).collect()}
    assert (scored[0]["n_known"], scored[1]["n_known"]) == (3, 2)


def test_shingles_and_words():
    h = WordHasher()
    texts = [b"a b c", b"", b" ", b"one", b"a b " + b"z" * 70 + b" q", b"\x0bx\x0cy\r"]
    found, bounds = h.many(texts)
    assert [found[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:], strict=True)] == [h(t).tolist() for t in texts]
    assert [s.tolist() for s in shingle_sets(found, bounds, 2)] == [shingles(h(t), 2).tolist() for t in texts]
    assert len(h(b" a  b\tc\n")) == 3 and h(b"xx a")[1] == h(b"a")[0] and len(set(h(b"ab ba aa b").tolist())) == 4
    assert len(shingles(h(b"a b a b a b"), 2)) == 2 and len(shingles(h(b"a"), 2)) == 1 and len(shingles(h(b""), 2)) == 0


# ------------------------------------------------------------------------ lines


def brute_lines(rows):
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def line_rows(seed=2, n=60):
    draw = random.Random(seed)
    pool = [f"line number {i} of the pool" for i in range(25)] + ["short", "", "  Line NUMBER 3 of the pool ", "ééééééééé", "éééééééééé"]
    return [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(0, 6)))) for i in range(100, 100 + n)]


def collected(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=repr)


def test_lines_equal_brute_force(spark):
    rows = [*ODD, *line_rows()]
    assert collected(line_dedup.dedup_lines(table(spark, rows), keep=("lang",))) == brute_lines(rows)
    bound, line_dedup.BROADCAST_BYTES = line_dedup.BROADCAST_BYTES, 0
    try:
        assert collected(line_dedup.dedup_lines(table(spark, rows))) == brute_lines(rows)
    finally:
        line_dedup.BROADCAST_BYTES = bound
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_lines_are_reversible(spark):
    first, more = line_rows(4, 30), [(i + 500, t) for i, t in line_rows(5, 30)]
    docs = lambda rows: spark.createDataFrame(rows, SCHEMA)
    start = line_dedup.LineIndex.build(docs(first))
    grown = start.insert(docs(more))
    assert collected(grown.apply(docs(first + more))) == brute_lines(first + more)
    gone = {first[0][0], first[3][0], more[2][0]}
    left = [r for r in first + more if r[0] not in gone]
    cut = grown.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    assert collected(cut.apply(docs(left))) == brute_lines(left)
    back = grown.delete(docs(more).select("doc_id"))
    assert collected(back.apply(docs(first))) == brute_lines(first) == collected(start.apply(docs(first)))


def test_cuckoo_filter():
    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(-(2**63), 2**63 - 1, 20_000, dtype=np.int64))
    made = cuckoo.CuckooFilter.of(keys[:10_000])
    assert made.has(keys[:10_000]).all() and made.has(keys[10_000:]).mean() < 0.01
    again = cuckoo.CuckooFilter.load(made.dump())
    again.remove(keys[:5_000])
    assert again.has(keys[5_000:10_000]).all() and again.has(keys[:5_000]).mean() < 0.01
    assert (again.table > 0).sum() == 5_000 and again.add(keys[:5_000]) and again.has(keys[:10_000]).all()


# ----------------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, budget, out = set(names), Fraction(share) * sum(sizes.values()), {}
    while left:
        total = sum(w[s] for s in left)
        full = [s for s in left if budget * w[s] > cap * sizes[s] * total]
        if not full:
            out |= {s: budget * w[s] / total for s in left}
            break
        for s in full:
            out[s] = Fraction(cap * sizes[s])
            left.discard(s)
        budget = Fraction(share) * sum(sizes.values()) - sum(out.values())
    return out


def test_mixing(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(["w"] * draw.randint(0, 200))) for i in range(400)]
    docs = table(spark, [*rows, *ODD]).withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") < 250, "b").otherwise(F.concat(F.lit("a"), F.col("doc_id") % 5)))
    got = [tuple(r) for r in mixing.mix(docs, shard_rows=50).collect()]
    again = [tuple(r) for r in mixing.mix(docs.repartition(5), shard_rows=50).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr) and len(got) == 400 + len(ODD)
    sizes, taken, target = Counter(), Counter(), {}
    for _, source, size, whole, goal, took in got:
        sizes[source] += size
        taken[source] += took
        target[source] = goal
        assert 0 <= took <= 2 * size
    expected = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - expected[s]) < 1e-6 * max(1, expected[s])
        assert abs(taken[s] - target[s]) <= max(40, 0.02 * target[s])
    assert mixing.mix(empty(spark)).count() == 0
    few, mixing._BROADCAST_SOURCES = mixing._BROADCAST_SOURCES, 0
    try:
        assert sorted((tuple(r) for r in mixing.mix(docs, shard_rows=50).collect()), key=repr) == sorted(got, key=repr)
    finally:
        mixing._BROADCAST_SOURCES = few


def test_sainte_lague_equals_highest_quotients(spark):
    draw = random.Random(4)
    rows = [(g, i, draw.choice([0, 1, draw.randint(1, 50), draw.randint(1, 5000)])) for g in range(12) for i in range(draw.randint(1, 9))]
    seats = {g: draw.choice([0, 1, 7, 100, 999]) for g in range(12)}
    df = spark.createDataFrame([(g, i, w, seats[g]) for g, i, w in rows], "g int, i int, w long, seats long")
    got = {(r["g"], r["i"]): r["won"] for r in mixing.sainte_lague(df, "w", F.col("seats"), [F.col("i")], ["g"], "won").collect()}
    for g, n in seats.items():
        mine = [(i, w) for h, i, w in rows if h == g]
        won = Counter()
        if any(w for _, w in mine):
            for _ in range(n):
                won[max((iw for iw in mine if iw[1]), key=lambda iw: (Fraction(iw[1], 2 * won[iw[0]] + 1), -iw[0]))[0]] += 1
        assert {i: got[g, i] for i, _ in mine} == {i: won[i] for i, _ in mine}


def test_mixing_plan_is_native(spark):
    plan = mixing.mix(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -------------------------------------------------------------------- embeddings


def test_embeddings_equal_brute_force(spark):
    draw = np.random.default_rng(6)
    base = draw.normal(size=(30, 16))
    x = np.concatenate([base, base[:20] + draw.normal(size=(20, 16)) * 0.25, base[:10] * 3, base[:5], np.ones((3, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [float("inf")] * 16), (904, [None] + [1.0] * 15), (905, []), (906, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"n": F.lit(1), "links": F.lit(2), "block": F.lit(3)})
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    expected = brute_components(range(len(x)), lambda a, b: linked[a, b])
    got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(df, block_rows=16, group_blocks=1).collect()}
    assert len(got) == len(rows) + len(bad)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (linked[i].sum() - 1, expected[i]) and got[i]["kept"] == (expected[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i, _ in bad)
    assert embedding_dedup.link_vectors(df.filter("false")).count() == 0


def test_distant_groups_are_skipped(spark):
    """Clusters far apart: no group meets all others, and nothing is lost by it."""
    draw = np.random.default_rng(8)
    centres = np.linalg.qr(draw.normal(size=(32, 32)))[0][:8]
    vectors = [centres[i % 8] + draw.normal(size=32) * 0.02 * (1 + i % 3) for i in range(400)]
    unit = embedding_dedup.unit(np.array(vectors))
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    met, partners = [], embedding_dedup._partners
    embedding_dedup._partners = lambda packed, groups, threshold: met.append((groups, partners(packed, groups, threshold).count())) or partners(packed, groups, threshold)
    try:
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.link_vectors(df, block_rows=25, group_blocks=1).collect()}
    finally:
        embedding_dedup._partners = partners
    assert got == dict(enumerate(linked.sum(axis=1).tolist()))
    assert met[0][0] >= 8 and met[0][1] < 0.75 * met[0][0] ** 2


def test_quantisation_bound_holds():
    draw = np.random.default_rng(2)
    u = embedding_dedup.unit(draw.normal(size=(200, 64)) * np.exp(draw.normal(size=(200, 64))))
    codes, scale, lost = embedding_dedup.quantise(u)
    near = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
    bound = lost[:, None] * (1 + lost[None, :]) + lost[None, :]
    assert (np.abs(near - u @ u.T) <= bound + 1e-9).all()


# ---------------------------------------------------------------- learned operators


def test_quality_counts(spark):
    def brute(text):
        text = text or ""
        w = text.encode().split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        return [len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)]

    count = quality.Statistics()
    draw = random.Random(9)
    texts = [t for _, t in ODD] + ["".join(draw.choice(["a", "b ", "c d ", "\n", "#", "é", " x y z ", " "]) for _ in range(draw.randint(0, 60))) for _ in range(500)]
    for t in texts:
        assert count(t)[0] == brute(t), repr(t)
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge(table(spark), quality.train(table(spark), labels)).collect()
    assert len(got) == len(ODD) and all(not r["kept"] for r in got if r["base_failed"])
    assert quality.judge(empty(spark), quality.train(empty(spark), labels.filter("false"))).count() == 0


def test_trees_learn_and_keep_their_constraints():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2000, 3))
    y = (x[:, 0] + 0.5 * np.sin(4 * x[:, 1]) + draw.normal(size=2000) * 0.2 > 0).astype(float)
    model = quality.grow(x, y, [1, 0, -1])
    assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.93
    line = np.tile(x[:1], (200, 1))
    for j, sign in ((0, 1), (2, -1)):
        probe = line.copy()
        probe[:, j] = np.linspace(-4, 4, 200)
        assert (sign * np.diff(model.raw(probe)) >= -1e-12).all()


@pytest.mark.parametrize("block", [4, 64])
def test_block_max_index_is_exact(block, monkeypatch):
    """Groups of examples over different terms, so that blocks can be skipped."""
    monkeypatch.setattr(toxicity, "AT_ONCE", 50 if block == 4 else 500_000)
    draw = random.Random(7)
    weight = np.array([draw.uniform(1, 5) for _ in range(160)])
    model = toxicity.ToxicityModel([b"t"] * 160, weight, np.arange(400), np.zeros(400), np.ones(400), None, 0.1, 7)
    bags = [{40 * (i % 4) + draw.randrange(40) if draw.random() < 0.97 else draw.randrange(160): draw.randint(1, 4) for _ in range(draw.randint(1, 9))} for i in range(400)]
    rows = [model.vector(b) for b in bags]
    dense = np.zeros((400, 160))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(rows, 160, block)
    assert sorted(index.order.tolist()) == list(range(400))
    found = index.all_nearest(rows, 7, [q if q % 2 else -1 for q in range(400)])
    for q, (numbers, cosines) in enumerate(found):
        cosine = dense @ dense[q]
        if q % 2:
            cosine[q] = -1
        want = sorted(((-round(c, 12), i) for i, c in enumerate(cosine) if c > 0))[:7]
        assert numbers.tolist() == [i for _, i in want] and np.allclose(cosines, [-c for c, _ in want])
    assert index.visited < 0.8 * index.possible
    assert len(toxicity.BlockMaxIndex([], 3).nearest(np.array([1]), np.array([1.0]), 5)[0]) == 0


def test_neighbours_of_real_texts_equal_brute_force():
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("the tables are not here")
    texts = pq.read_table(path, columns=["text"]).column("text").to_pylist()[:700]
    terms = sorted({w for t in texts[:500] for w in toxicity.words_of(t)})
    count, held = toxicity.TermCounter(terms), Counter(w for t in texts for w in set(toxicity.words_of(t)))
    weight = np.array([math.log(701 / (1 + held[t])) + 1 for t in terms])
    model = toxicity.ToxicityModel(terms, weight, np.arange(500), np.zeros(500), np.ones(500), None, 0.1, 15)
    vectors = [model.unit(*count.arrays(t)) for t in texts]
    index = toxicity.BlockMaxIndex(vectors[:500], len(terms))
    dense = np.zeros((500, len(terms)))
    for row, (t, w) in zip(dense, vectors, strict=False):
        row[t] = w
    for (t, w), (numbers, cosines) in zip(vectors, index.all_nearest(vectors, 15), strict=True):
        cosine = dense[:, t] @ w
        want = sorted((-round(float(c), 12), i) for i, c in enumerate(cosine) if c > 0)[:15]
        assert np.allclose(cosines, [-c for c, _ in want], atol=1e-10)
        clear = [k for k in range(len(want)) if sum(abs(want[k][0] - c) < 1e-9 for c, _ in want) == 1 and k < 14]
        assert [numbers[k] for k in clear] == [want[k][1] for k in clear]
    assert index.visited < index.possible


def test_terms_are_counted_alike():
    draw = random.Random(3)
    texts = ["".join(draw.choice(["ab", "abc", "d", "efgh", " ", ".", "É", "\n", "1"]) for _ in range(draw.randint(0, 40))) for _ in range(400)] + [None]
    every = [Counter(toxicity.words_of(text)) for text in texts]
    terms = sorted({t for c in every for t in c})[::3]
    count, ids = toxicity.TermCounter(terms), {t: i for i, t in enumerate(terms)}
    assert [count(t) for t in texts] == [{ids[t]: n for t, n in c.items() if t in ids} for c in every]
    assert all((np.diff(count.arrays(t)[0]) > 0).all() for t in texts) and toxicity.TermCounter([])("ab") == {}


def test_words_of_many_texts_are_looked_up_alike(monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choice(["ab", "Ab", "abc", "d", "efgh", " ", ".", "É", "İ", "\u0085", "\u00a0", "\x1c", "\n", "\t", "1", "文字"]) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    texts[7:7] = [None, "", " . ", None]
    terms = sorted({w for text in texts for w in toxicity.words_of(text)}, reverse=True)[::2]
    for known in (terms, [], [b"absent"]):
        count = toxicity.TermCounter(known)
        for limit in (1, 60, 4_000_000):
            monkeypatch.setattr(toxicity, "CHARACTERS", limit)
            batches = list(toxicity.batches_of(texts))
            assert [t for b in batches for t in b] == texts and all(len(b) == 1 or sum(len(t or "") for t in b) <= limit for b in batches)
            for (ids, times), text in zip((bag for b in batches for bag in count.many(b)), texts, strict=True):
                want_ids, want_times = count.arrays(text)
                assert ids.tolist() == want_ids.tolist() and times.tolist() == want_times.tolist()


def test_long_examples_cost_texts_that_share_few_terms_little():
    """A text pays for the terms it shares with examples, not for all terms of its neighbours."""
    draw = np.random.default_rng(5)
    shared, own, n = 60, 10_000, 200

    def taken(more):
        rows = []
        for i in range(n):
            terms = np.concatenate([np.sort(draw.choice(shared, 20, replace=False)), shared + i * more + np.arange(more)])
            weights = draw.uniform(1, 2, len(terms))
            rows.append((terms, weights / np.sqrt((weights**2).sum())))
        index = toxicity.BlockMaxIndex(rows, shared + n * more)
        vectors = [(t[:20], w[:20] / np.sqrt((w[:20] ** 2).sum())) for t, w in rows]
        took = []
        for _ in range(3):
            began = time.process_time()
            index.all_nearest(vectors, 60)
            took.append(time.process_time() - began)
        return min(took)

    assert taken(own) < 4 * taken(0)


def test_index_takes_a_task_little_more_than_its_lists():
    """A task that reads the broadcast index neither holds its postings twice nor sorts them again."""
    draw = np.random.default_rng(6)
    rows = []
    for _ in range(1500):
        terms = np.unique(np.concatenate([draw.choice(40, 20), 40 + draw.choice(20_000, 200)]))
        weights = draw.uniform(1, 2, len(terms))
        rows.append((terms, weights / np.sqrt((weights**2).sum())))
    index = toxicity.BlockMaxIndex(rows, 20_040)
    want = index.all_nearest(rows[:20], 7)
    sent = pickle.dumps(index.resting())
    tracemalloc.start()
    woken = pickle.loads(sent)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.2 * len(sent) + 3 * woken.dense.nbytes
    for (numbers, cosines), (same, alike) in zip(want, woken.all_nearest(rows[:20], 7), strict=True):
        assert numbers.tolist() == same.tolist() and cosines.tolist() == alike.tolist()


def test_toxicity_without_evidence(spark):
    """The same scores, without the columns that the pipeline drops; texts with spaces at their ends have no empty term."""
    texts = [f" {s} " for s in sentences(8, 300, ["river", "stone", "cloud", "an"], ["vilest"])] + ["", None, "  "]
    docs = spark.createDataFrame([(i, t, [i, None]) for i, t in enumerate(texts)], "doc_id long, text string, more array<int>")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(303)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert sorted(model.terms) == sorted({w for text in texts for w in toxicity.words_of(text)})
    full = {r["doc_id"]: r for r in toxicity.score(docs, model, keep=("more", "text")).collect()}
    lean = toxicity.score(docs, model, keep=("more", "text"), evidence=False)
    assert lean.columns == ["doc_id", "more", "text", "score", "predicted"] and lean.count() == len(texts)
    for r in lean.collect():
        assert r.asDict() == {c: full[r["doc_id"]][c] for c in lean.columns} and r["text"] == texts[r["doc_id"]] and r["more"] == [r["doc_id"], None]


def sentences(seed, n, lexicon, extra=None):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        w = [draw.choice(lexicon) for _ in range(draw.randint(5, 60))]
        if extra and i % 4 == 0:
            w[draw.randrange(len(w))] = draw.choice(extra)
        out.append(" ".join(w))
    return out


def test_toxicity_on_held_out_rows(spark):
    lexicon = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "on", "er", "ish", "ade", "ully")]
    texts = sentences(1, 1200, lexicon, ["vilest", "vilely", "awfulx"])
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).unionByName(table(spark).select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 5000))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(1200) if i % 3 == 0]
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and len(r["neighbours"]) == len(r["cosines"]) for r in got.values()) and got[5002]["predicted"] == 0
    none = toxicity.train(empty(spark), labels.filter("false"), F.lit(True))
    assert toxicity.score(empty(spark), none).count() == 0 and toxicity.score(table(spark), none, keep=("lang",)).count() == len(ODD)


def test_toxicity_uses_all_terms(spark):
    lexicon = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "on", "er", "ish", "ade", "ully")]
    texts = sentences(1, 400, lexicon, ["vilest", "vilely", "awfulx"])
    odd = ["quorn zephyr blintz", "mumpsimus gallimaufry"]  # no term that goes with the label
    rows = list(enumerate(texts + odd)) + [(900, odd[0]), (901, odd[1] + " " + odd[1]), (902, "zephyr"), (903, "unseenword"), (904, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(402)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    examples = [rows[i][1] for i in range(402)]
    assert set(model.terms) == {w for text in examples for w in toxicity.words_of(text)}
    weight = dict(zip(model.terms, model.weight.tolist(), strict=True))

    def bag(text):
        times = Counter(toxicity.words_of(text))
        vector = {t: (1 + math.log(n)) * weight[t] for t, n in times.items() if t in weight}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        return {t: v / norm for t, v in vector.items()}

    held = Counter(t for _, text in rows for t in set(toxicity.words_of(text)))
    assert all(math.isclose(weight[t], math.log((1 + len(rows)) / (1 + held[t])) + 1) for t in weight)  # plain inverse document frequencies
    strength = dict(zip(model.terms, model.strength.tolist(), strict=True))
    toxic = [float(i % 4 == 0) for i in range(402)]
    has = {t: [t in toxicity.words_of(text) for text in examples] for t in (b"vilest", b"an", b"ban", b"zephyr") if t in weight}
    for t, present in has.items():
        a, b = sum(h and y for h, y in zip(present, toxic, strict=True)), sum(h and not y for h, y in zip(present, toxic, strict=True))
        c, d = sum(toxic) - a, 402 - sum(toxic) - b
        want = 402 * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)) if a + b >= 5 else 0
        assert math.isclose(strength[t], 1 + want, rel_tol=1e-9)

    def strong(vector):
        norm = math.sqrt(sum((v * strength[t]) ** 2 for t, v in vector.items()))
        return {t: v * strength[t] / norm for t, v in vector.items()}

    bags = [bag(text) for text in examples]
    strong_bags = [strong(b) for b in bags]
    for r in toxicity.score(docs, model).collect():
        mine = bag(dict(rows)[r["doc_id"]])
        near, vote, toxic_vote = strong(mine), model.votes.mean(), model.prior * model.votes.mean()
        for i in r["neighbours"]:
            v = model.votes[i] * math.exp(model.rate * sum(x * near.get(t, 0.0) for t, x in strong_bags[i].items()))
            vote, toxic_vote = vote + v, toxic_vote + v * toxic[i]
        p = min(1 - 1e-6, max(1e-6, toxic_vote / vote))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(model.slope * math.log(p / (1 - p)) + model.shift))), abs_tol=1e-9)
        want = sorted(((-round(c, 12), i) for i, b in enumerate(bags) if (c := sum(v * b.get(t, 0.0) for t, v in mine.items())) > 0))[: model.k]
        assert np.allclose(r["cosines"], [-c for c, _ in want], atol=1e-9) and len(r["neighbours"]) == len(want)
        if r["doc_id"] in (900, 901, 902):
            assert r["neighbours"][0] == 400 + (r["doc_id"] == 901)
        if r["doc_id"] in (900, 901):
            assert math.isclose(r["cosines"][0], 1)
        assert r["doc_id"] < 903 or r["neighbours"] == []


def test_language_on_held_out_rows(spark):
    kinds = {"aa": [f"{a}en{b}" for a in "kmnst" for b in ("ta", "ko", "ri")], "bb": [f"{a}un{b}" for a in "dfgzw" for b in ("esch", "ich", "auf")]}
    rows = [(i + 1000 * n, t, lang) for n, (lang, lex) in enumerate(kinds.items()) for i, t in enumerate(sentences(n, 200, lex))]
    odd = [(9000, None, "aa"), (9001, "12 34 !", "aa"), (9002, "kenta", None), (9003, "", "bb"), (9004, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "aa")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    model = language_id.train(docs, F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if i % 3 == 1) and len(got) == len(rows) + len(odd)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (9000, 9001, 9003, 9004)) and got[9002]["lang_pred"] == "aa"
    assert language_id.predict(docs.filter("false"), language_id.train(docs.filter("false"), F.lit(True))).count() == 0
    assert language_id.predict(docs, language_id.train(docs.filter("false"), F.lit(True))).filter("lang_pred <> 'und'").count() == 0


def test_kernel_counts_common_grams():
    a, b = np.zeros(language_id.DIMENSIONS, dtype=np.uint8), np.zeros(language_id.DIMENSIONS, dtype=np.uint8)
    language_id.presence("abab", a)
    language_id.presence("ABa", b)
    assert a.sum() == 2 + 2 + 2 and b.sum() == 2 + 2 + 1 and (a & b).sum() == 5


# ------------------------------------------------------------------ language model


def brute_ppm(training, order=language_model.ORDER):
    counts, start = {}, b"\xff" * order
    for t in training:
        data = start + t.encode() + b"\xff"
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k : i], Counter())[data[i]] += 1

    def log10(text):
        data = start + text.encode() + b"\xff"
        total = 0.0
        for i in range(order, len(data)):
            p, gone, symbol = 1.0, set(), data[i]
            for k in range(order, -1, -1):
                seen = {s: n for s, n in counts.get(data[i - k : i], {}).items() if s not in gone}
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if symbol in seen:
                    p *= seen[symbol] / whole
                    break
                p *= len(seen) / whole
                gone |= set(seen)
            else:
                p /= 256 - len(gone)
            total += math.log10(p)
        return total

    return log10


def test_language_model_equals_brute_force(spark):
    rows = [*ODD, *((20 + i, t) for i, t in enumerate(sentences(3, 40, ["alpha", "beta", "Gamma", "delta", "éta"])))]
    learns = lambda i: i is not None and i % 3 != 0
    training = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    got = language_model.score(table(spark, rows), training, max_frequent=4).collect()
    counts = Counter()
    for i, t in rows:
        if learns(i):
            counts.update([*words(t), None])
    n, v, ppm = sum(counts.values()), len(counts), brute_ppm([t or "" for i, t in rows if learns(i)])
    want = sorted(
        (repr(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6), round(ppm(t or ""), 2))
        for i, t in rows
    )
    have = sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 2)) for r in got)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    assert all(abs(h[4] - w[4]) < 1e-3 and abs(h[5] - w[5]) < 1e-6 * max(1e4, abs(w[5])) for h, w in zip(have, want, strict=True))
    assert language_model.score(empty(spark), F.lit(True)).count() == 0
    assert language_model.score(table(spark, rows), F.lit(False)).count() == len(rows)


def test_language_model_leaves_no_context_out(spark):
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEF"
    wide = [(i, "".join(draw.choice(letters) for _ in range(3000))) for i in range(30)] + [(30, ""), (31, None)]
    some = [(i, t) for i, t in enumerate(sentences(3, 40, ["alpha", "beta", "Gamma", "delta", "éta"]))] + [(40, "zzz Ω"), (41, "")]
    assert len({t[i : i + 6] for _, t in wide for i in range(len(t or ""))}) > 20_000
    for rows, bound in ((wide, {}), (some, {"max_runs": 5}), (some, {"max_runs": 150}), (wide[:6] + [(i + 99, t) for i, t in some], {"max_runs": 4000})):
        got = language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 3 != 0, **bound).collect()
        ppm = brute_ppm([t or "" for i, t in rows if i % 3])
        text_of = dict(rows)
        assert len(got) == len(rows)
        assert all(math.isclose(r["score"], ppm(text_of[r["doc_id"]] or ""), rel_tol=1e-5, abs_tol=1e-4) for r in got)


def test_probabilities_sum_to_one():
    texts = [t.encode() for t in sentences(4, 30, ["abra", "cad", "ab", "dab"])] + [b""]
    keys, counts = np.unique(language_model.runs_of(texts)[0], return_counts=True)
    assert counts.sum() == sum(len(t) + 1 for t in texts)
    trie = language_model.Trie({language_model.ORDER: (keys, counts)})
    contexts = np.concatenate([np.unique(keys >> np.uint64(8)), np.array([0, 0x6162, 0x7A61], dtype=np.uint64)])
    every = ((contexts << np.uint64(8))[:, None] | np.arange(256, dtype=np.uint64)[None, :]).ravel()
    logs, unknown = trie.logs(every)
    assert not unknown.any() and np.allclose((10.0**logs).reshape(-1, 256).sum(axis=1), 1, atol=1e-9)
    empty_trie = language_model.Trie({language_model.ORDER: (keys[:0], counts[:0])})
    assert np.allclose(empty_trie.logs(keys)[0], -math.log10(256))


# --------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    lexicon = [f"{a}{b}{c}" for a in "bcdfgh" for b in ("an", "on", "er") for c in ("ish", "ade", "")]
    texts = sentences(1, 300, lexicon, ["vilest", "vilely"])
    rows = [(i, t + (" \nA license line that repeats" if i % 10 == 0 else ""), "aa", f"s{i % 4}", 0) for i, t in enumerate(texts)]
    long = [i for i, t in enumerate(texts) if i % 4 and i % 10 and len(t.split()) > 30][:3]
    rows += [(1000 + i, rows[i][1] + " end", "aa", "s0", 0) for i in long] + [(2000, None, None, None, None), (2001, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in seen.select("doc_id").collect()}
        if name == "toxicity":
            assert len([i for i in ids if i < 1000 and i % 4 == 0]) <= 3 and len([i for i in ids if i < 1000 and i % 4]) >= 223
        if name == "line_dedup":
            assert seen.filter("text like '%license line%'").count() == 1
        if name == "near_dedup":
            assert set(long) <= ids and not ids & {1000 + i for i in long} and 2001 in ids
    assert seen.count() > 0
    empty_docs = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, str(tmp_path)).count() == 0


def test_pipeline_mixes_to_the_word(spark, tmp_path):
    import corpus_pipeline

    one = lambda n, tag: " ".join(f"{tag}{i}" + ("\n" if i % 7 == 0 else "") for i in range(n))
    rows = [(0, " " + one(1000, "a"), "s0", 1), (1, one(700, "b"), "s1", 1), (2, one(90, "c"), "s1", 1), (3, None, "s1", 1), (4, "", None, 1)]
    rows += [(10 + i, one(20 + i, f"d{i}x"), "s2", 1) for i in range(60)] + [(7, one(33, "e"), None, 1), (7, one(33, "f"), None, 1), (None, one(50, "g"), "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    want = Counter()
    for r in corpus_pipeline.mixing.mix(docs.select("doc_id", "source", "text")).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    got, held = Counter(), {}
    for i, t, s, _ in rows:
        held.setdefault((i, s), []).append(t or "")
    out = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    for r in out:
        got[r["doc_id"], r["source"]] += len(r["text"].split())
        assert any(f" {' '.join(r['text'].split())} " in f" {' '.join(t.split())} " for t in held[r["doc_id"], r["source"]])
        assert r["text"] in held[r["doc_id"], r["source"]] or any(r["text"] in t for t in held[r["doc_id"], r["source"]]) and r["n_chars"] == len(r["text"])
    assert got == +want and any(r["text"] not in held[r["doc_id"], r["source"]] for r in out)


def test_split_by_checksum(spark):
    from pathloom.llm.common import crc_mod

    got = [r[0] for r in spark.range(50).select(crc_mod("id", 7)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 7 for i in range(50)]
