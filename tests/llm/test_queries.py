"""The registered corpus queries on odd tables: nulls, ties, repeats, long texts, clashing columns, nothing at all."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm.queries import QUERIES, vocabulary

from .test_corpus import ODD, brute_components, brute_lines, brute_ppm, brute_sets, brute_targets, sentences, true_ids

WORD = re.compile("[^\x20\x09-\x0d]+")


def odd_rows():
    lexicons = {"aa": [f"{a}en{b}" for a in "kmnst" for b in ("ta", "ko", "ri")], "bb": [f"{a}un{b}" for a in "dfgzw" for b in ("esch", "ich", "auf")]}
    rows = [(i, t, "aa" if (i or 0) % 2 else "bb", [None, "s1", "s2"][(i or 0) % 3]) for i, t in ODD]
    for n, (lang, lexicon) in enumerate(lexicons.items()):
        rows += [(100 * (n + 1) + i, t + "\nthe same long line here" * (i % 5 == 0), lang, f"s{i % 3}") for i, t in enumerate(sentences(n, 80, lexicon, ["vilest"]))]
    return rows + [(300, rows[20][1], "aa", None), (301, rows[20][1] + " more", None, "s1"), (302, "longest " + " ".join(f"w{i % 5000}" for i in range(60_000)), "aa", "s2")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of odd tables, and one of the same tables without rows."""
    odd, none = (f"file://{tmp_path_factory.mktemp(n)}" for n in ("odd", "none"))
    names = ("score", "kept", "n", "size", "key", "bands", "sequence_id", "shard", "predicted", "_drops", "n_words", "rank", "target", "_copy", "_valid", "held_out", "taken")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd_rows()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    labels = [(i, int(i % 3 == 0) if i % 7 else None, int(i % 4 == 0) if i % 5 else None) for i in range(320)] + [(None, 1, 1), (101, 0, 0), (101, 1, 1)]
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    draw = np.random.default_rng(3)
    base = draw.normal(size=(12, 16))
    vectors = [(i, (base[i % 12] + draw.normal(size=16) * 0.05 * (i % 7)).tolist()) for i in range(90)]
    vectors += [(200, None), (201, [0.0] * 16), (202, [math.nan] * 16), (203, [1.0, None]), (204, []), (0, vectors[0][1]), (None, vectors[0][1]), (205, [3.0, 4.0])]
    embedded = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("block", F.lit(0))
    for name, table in (("documents", docs), ("labels", labelled), ("embeddings", embedded)):
        table.write.parquet(f"{odd}/{name}.parquet")
        table.filter("false").write.parquet(f"{none}/{name}.parquet")
    return odd, none, vectors


def run(spark, tables, name):
    return QUERIES[name](spark, tables[0]).collect()


def held_out(doc_id, modulus, rest):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == rest


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, tables, name):
    assert QUERIES[name](spark, tables[1]).count() == 0


def test_op1(spark, tables):
    from tokenizers import Tokenizer

    whole, rows = Tokenizer.from_file(vocabulary()), odd_rows()
    total = sum(len(true_ids(whole, t)) for _, t, *_ in rows)
    got, once = run(spark, tables, "op1_packing"), Counter(r[0] for r in rows)
    assert sum(r["length"] for r in got) == total
    of, sequences = {}, {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(of) == set(once)
    for doc_id, text, *_ in rows:
        if once[doc_id] == 1:
            ids, at = true_ids(whole, text), 0
            for r in sorted(of[doc_id], key=lambda r: r["start"]):
                part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
                at += r["length"]
            assert at == len(ids)
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= total / 2048 * 1.1 + 1


def test_op2(spark, tables):
    sets = brute_sets([r[:2] for r in odd_rows()], 2)
    expected = brute_components(sets, lambda a, b: any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]))
    for r in run(spark, tables, "op2_near_dedup"):
        assert r["doc_id"] is None or (r["component_id"] == expected[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"]) and r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]})


def test_op3(spark, tables):
    got = run(spark, tables, "op3_toxicity")
    assert len(got) == len(odd_rows())
    assert all(r["held_out"] == held_out(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_op4(spark, tables):
    rows = [r[:2] for r in odd_rows()]
    want = brute_lines(rows)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in run(spark, tables, "op4_lines"))
    assert got == Counter({(i, n, d, sha256(t.encode()).hexdigest()): c for (i, t, n, d), c in Counter(tuple(x) for x in want).items()})


def test_op5(spark, tables):
    got, rows = run(spark, tables, "op5_language"), {r[0]: r for r in odd_rows()}
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("aa", "bb", "und") for r in got)
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in got if r["doc_id"] and 100 <= r["doc_id"] < 300)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} >= {2, 3, 4}


def test_op6(spark, tables):
    rows, got = odd_rows(), run(spark, tables, "op6_mixing")
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    targets = {float(v): k for k, v in brute_targets(sizes).items()}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(t - target) <= 32 and any(math.isclose(target, x, rel_tol=1e-9) for x in targets) for (target, _), t in taken.items())
    again = run(spark, tables, "op6_mixing")
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_op7(spark, tables):
    from tokenizers import Tokenizer

    whole, rows = Tokenizer.from_file(vocabulary()), odd_rows()
    want, at = Counter(), 0
    got = sorted(run(spark, tables, "op7_binary"), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    for i, text, *_ in rows:
        want[i, zlib.crc32(np.array(true_ids(whole, text), "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want


def test_op8(spark, tables):
    vectors = tables[2]
    good = [(n, i, np.array(v)) for n, (i, v) in enumerate(vectors) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {n: v / np.linalg.norm(v) for n, _, v in good}
    linked = lambda a, b: len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.95
    ids = {n: i for n, i, _ in good}
    component = brute_components({i for _, i, _ in good}, lambda x, y: any(linked(a, b) for a in ids if ids[a] == x for b in ids if ids[b] == y))
    links = Counter((ids[a], sum(linked(a, b) for b in ids if b != a)) for a in ids)
    got = run(spark, tables, "op8_embeddings")
    assert len(got) == len(vectors)
    for r in got:
        if r["vec_id"] in component:
            assert r["component_id"] == component[r["vec_id"]]
        else:
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"]
    assert Counter((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] in component) == links


def test_op9(spark, tables):
    def base(text):
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)

    want = Counter((i, *base(t)) for i, t, *_ in odd_rows())
    got = run(spark, tables, "op9_quality")
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got)


def test_op10(spark, tables):
    rows = odd_rows()
    training = [t or "" for i, t, *_ in rows if not held_out(i, 7, 2)]
    n_training = sum(len(WORD.findall(t)) for t in training) + len(training)
    ppm, texts = brute_ppm(training), {}
    for i, t, *_ in rows:
        texts.setdefault(i, t or "")
    for r in run(spark, tables, "op10_language_model"):
        assert r["held_out"] == held_out(r["doc_id"], 7, 2) and r["train_tokens"] == n_training
        assert r["n_tokens"] == len(WORD.findall(texts[r["doc_id"]])) + 1
        if len(texts[r["doc_id"]]) < 5000:
            assert math.isclose(r["score"], ppm(texts[r["doc_id"]]), rel_tol=1e-6, abs_tol=1e-6)


def test_pipeline(spark, tables):
    got = run(spark, tables, "pipeline")
    assert got and {r["doc_id"] for r in got} <= {r[0] for r in odd_rows()} and all(0 < r["length"] <= 2048 for r in got)


def test_draws_are_bounded_by_rows(spark):
    from pathloom.llm import language_id, quality, toxicity

    draw = random.Random(2)
    rows = [(i % 3, " ".join(draw.choice(["ab", "cd", "ef", "gh"]) + str(draw.randint(0, 99)) for _ in range(8)), "aa") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit, language_id.fit = language_id.fit, lambda bits, labels, **_: seen.append(len(labels)) or fit(bits, labels, landmarks=4)
    try:
        language_id.train(docs, F.lit(True), max_rows=300)
        language_id.train(docs.withColumn("doc_id", F.lit(None).cast("long")), F.lit(True), max_rows=300)
    finally:
        language_id.fit = fit
    assert all(200 < n < 400 for n in seen) and len(seen) == 2
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), max_examples=200)
    assert 250 < len(model.ids) < 500
    grow, quality.grow = quality.grow, lambda x, y, *a, **k: seen.append(len(y)) or grow(x, y, *a, **k)
    try:
        quality.train(docs, labels, max_labelled=200)
    finally:
        quality.grow = grow
    assert 120 < seen[-1] < 290


def test_shards_level_by_level(spark):
    from pathloom.llm import mixing

    draw = random.Random(4)
    sizes = {(r, s): draw.randint(1, 900) for r, n in ((0, 40), (1, 3)) for s in range(n)}
    shards = spark.createDataFrame([(r, s, 977 if r == 0 else 20, size) for (r, s), size in sizes.items()], "rank int, shard long, blocks long, shard_size long")
    for fan in (3, 512):
        got = {(r["rank"], r["shard"]): r["quota"] for r in mixing.shard_quotas(shards, 40, fan).collect()}
        assert set(got) == set(sizes)
        for rank, blocks in ((0, 977), (1, 20)):
            mine = {s: q for (r, s), q in got.items() if r == rank}
            total = sum(v for (r, _), v in sizes.items() if r == rank)
            assert sum(mine.values()) == blocks and all(abs(q - blocks * sizes[rank, s] / total) < 4 for s, q in mine.items())


def test_equal_rows_spread_over_shards(spark):
    from pathloom.llm import mixing

    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    got = mixing.mix(docs, shard_rows=100, parts=True)
    assert abs(got.agg(F.sum("taken")).first()[0] - 22_500) <= 16 and got.count() == 5000
    assert got.filter("taken > 3").count() > 500  # a run of blocks in each of the 50 shards and not one run in all


def test_files_in_the_order_of_their_numbers(spark):
    from pathloom.llm import binary

    names = ["part-99999-x.txt", "part-100000-x.txt", "part-00002-x.txt", "part-10001-x.txt"]
    got = spark.createDataFrame([(n,) for n in names], "file string").orderBy(binary.file_number("file"))
    assert [r[0] for r in got.collect()] == [names[2], names[3], names[0], names[1]]


def test_line_index_counts_documents(spark):
    from pathloom.llm import line_dedup

    docs = spark.createDataFrame([(1, "a shared line"), (1, "a shared line\nand more of it"), (2, "A shared line")], "doc_id long, text string")
    index = line_dedup.LineIndex.build(docs)
    assert [r["n_docs"] for r in index.shared.collect()] == [2]
    again = index.insert(docs)
    assert [r["n_docs"] for r in again.shared.collect()] == [2] and again.refs.count() == index.refs.count() == 3
    more = again.insert(spark.createDataFrame([(3, "and more of it"), (2, "and more of it")], "doc_id long, text string")).compact()
    assert sorted(r["n_docs"] for r in more.shared.collect()) == [2, 3]
    assert more.delete(spark.createDataFrame([(9,), (None,), (3,)], "doc_id long")).shared.count() == 2


def test_every_language_is_learned(spark):
    from pathloom.llm import language_id

    draw = random.Random(8)
    rows = [(i, " ".join("".join(draw.choice(f"{chr(0x4E00 + 4 * (i % 120))}{chr(0x4E01 + 4 * (i % 120))}{chr(0x4E02 + 4 * (i % 120))}") for _ in range(5)) for _ in range(6)), f"l{i % 120}") for i in range(1200)]
    docs = spark.createDataFrame([*rows, (5000, "12 34", "digits")], "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True), max_rows=60)  # fewer rows than languages
    assert len(model.languages) == 120 and 120 <= len(model.landmarks) < 300
    got = language_id.predict(docs, model).filter("doc_id < 5000").join(docs, "doc_id")
    assert got.filter("lang_pred = lang").count() > 1100


def test_predictions_equal_the_kernel_by_hand(spark):
    from pathloom.llm import language_id

    lexicons = {"aa": ["kento", "mita", "sori", "tenko"], "bb": ["dunesch", "fich", "gauf", "zunauf"], "cc": ["éla", "oqu", "ièn", "tou"]}
    rows = [(100 * n + i, t, lang) for n, (lang, lexicon) in enumerate(lexicons.items()) for i, t in enumerate(sentences(n, 30, lexicon, []))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.col("doc_id") % 3 != 1, max_rows=10_000)

    def grams(text):
        row = np.zeros(language_id.DIMENSIONS, dtype=np.uint8)
        language_id.presence(text, row)
        return frozenset(np.flatnonzero(row).tolist())

    landmarks = [frozenset(np.flatnonzero(np.unpackbits(b)).tolist()) for b in model.landmarks]
    for r in language_id.predict(docs, model).collect():
        own = grams(next(t for i, t, _ in rows if i == r["doc_id"]))
        kernel = np.array([len(own & x) / math.sqrt(len(own) * len(x)) for x in landmarks])
        values = kernel @ model.weights
        best = int(values.argmax())
        assert r["lang_pred"] == model.languages[best] and math.isclose(r["score"], min(1, max(0, values[best])), abs_tol=1e-4)


def test_op11(spark, tables):
    from .test_sketches_and_vectors import brute_fingerprint

    got = run(spark, tables, "op11_order_sketch")
    texts = {}
    for i, t, *_ in odd_rows():
        texts.setdefault(i, t or "")
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows())
    ids = sorted(texts, key=lambda i: (i is not None, i or 0))
    after = {i: texts[ids[(n + 1) % len(ids)]] for n, i in enumerate(ids)}
    for r in got:
        text = texts[r["doc_id"]]
        assert r["n_chars"] == len(text) and r["fingerprint"] == brute_fingerprint(text) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] != 7:
            edited = text[: len(text) - len(text) // 4] + after[r["doc_id"]][: len(text) // 4]
            assert r["edited_sha256"] == sha256(edited.encode()).hexdigest() and r["edited_fingerprint"] == brute_fingerprint(edited)


def test_op12(spark, tables):
    from .test_sketches_and_vectors import check_whitening

    good = [(i, v) for i, v in tables[2] if v and None not in v and np.isfinite(v).all()]
    got = [r for r in run(spark, tables, "op12_whitening") if r["vec_id"] != 205]
    check_whitening([(i, v) for i, v in good if len(v) == 16], got)


def test_op13(spark, tables):
    assert run(spark, tables, "op13_centroids") == []  # no vector has 64 components
