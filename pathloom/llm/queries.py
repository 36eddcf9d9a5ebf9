"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    pieces = packing.pack(read(spark, sf_dir, "documents"), vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup

    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .common import crc_mod

    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs, model, evidence=False).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.keeper AS dropped FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id
    from .common import crc_mod

    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs, crc_mod("doc_id", 3) != 1)
    return language_id.predict(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import binary
    from .common import fresh_path

    path = fresh_path(spark, "binary")
    binary.write(read(spark, sf_dir, "documents"), path, vocabulary())
    return binary.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup

    return embedding_dedup.link_vectors(read(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", *quality.BASE, "base_failed", "kept", "score")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_model
    from .common import crc_mod

    held_out = crc_mod("doc_id", 7) == 2
    scored = language_model.score(read(spark, sf_dir, "documents"), ~held_out)
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_order_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import order_sketch

    return order_sketch.edited_neighbours(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import centroids

    found = centroids.cluster(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op13_sql(rounds: int = 3) -> str:
    """Every vector against every centroid, round by round, in whole numbers."""
    assign = """SELECT vec_id, x, list_min(list_transform(cs, lambda c: {{'d': list_sum(list_transform(list_zip(x, c.x),
      lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'k': c.k}})) AS best FROM kept, (SELECT list(c{0}) AS cs FROM c{0})"""
    parts = [
        """kept AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM kept
    WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 16))""",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS (SELECT vec_id, x, best.k AS k FROM ({assign.format(i)}))")
        parts.append(f"""s{i} AS (SELECT k, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY k, i)""")
        parts.append(f"""m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{i} GROUP BY k)""")
        parts.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k)")
    parts.append(f"done AS (SELECT vec_id, best.k AS k, best.d AS d FROM ({assign.format(rounds)}))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, done.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY done.k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM done JOIN c{rounds} c ON c.k = done.k"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_near_dedup, op3_toxicity, op4_lines, op5_language, op6_mixing, op7_binary, op8_embeddings, op9_quality, op10_language_model, op11_order_sketch, op12_whitening, op13_centroids, pipeline)}
ORACLES: dict[str, str] = {"op4_lines": OP4_SQL, "op13_centroids": _op13_sql()}
