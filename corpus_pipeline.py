"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``docs``, whatever they are besides doc_id, text and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm import line_dedup, mixing, near_dedup, packing, toxicity
from pathloom.llm.common import crc_mod, materialize
from pathloom.llm.queries import read, vocabulary


def _hide(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns besides doc_id and text under names that clash with no operator's, and the way back."""
    names = {f"_held_{i}": c for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(h) for h, c in names.items())), names


def _show(rows: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    back = {c: h for h, c in names.items()}
    return rows.select(*(F.col(back.get(c, c)).alias(c) for c in columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject.

    Null and empty texts score as texts without evidence. Repeated rows and rows without
    doc_id are judged one by one; an empty table stays empty.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    hidden, names = _hide(docs)
    scored = toxicity.score(hidden, model, keep=(*names, "text"), evidence=False)
    return _show(scored.filter("predicted = 0"), names, docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller doc_id holds; n_chars follows the text."""
    hidden, names = _hide(docs)
    kept = _show(line_dedup.dedup_lines(hidden, keep=tuple(names)), names, docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates of five-word shingles at 0.8.

    Texts without words and rows without doc_id are in no group and stay. Rows that repeat
    a doc_id are one document and stay or go together. An empty table stays empty.
    """
    found = near_dedup.near_duplicates(docs)
    gone = found.filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; of one that it takes in part, a row with those words.

    Documents without words, null texts among them, are no part of a mix of words and go.
    A null source is a source of its own, a null doc_id an id like others; an empty table
    stays empty. n_chars follows the text. Rows alike in doc_id, source and number of words are
    told apart by their text.
    """
    hidden, names = _hide(docs)
    source = next(h for h, c in names.items() if c == "source")
    rows = hidden.withColumn("_words", mixing.words_in("text")).filter("_words > 0")
    alike = Window.partitionBy("doc_id", source, "_words").orderBy(F.xxhash64("text"), "text")
    rows = rows.withColumn("_place", F.row_number().over(alike))
    taken = mixing.mix(docs.select("doc_id", "source", "text"), parts=True).filter("size > 0")
    alike = Window.partitionBy("doc_id", "source", "size").orderBy(*mixing.PARTS)
    taken = taken.withColumn("_at", F.row_number().over(alike)).filter("taken > 0").select(
        F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_at", *(F.col(c).alias(f"_{c}") for c in mixing.PARTS)
    )
    rows = rows.join(
        taken,
        F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")) & (F.col("_place") == F.col("_at")),
    )
    part = lambda first, n: F.struct(first.cast("long").alias("first"), n.cast("long").alias("n"))
    whole = F.array_repeat(part(F.lit(0), F.col("_words")), F.col("_passes").cast("int"))
    rest = F.filter(F.array(part(F.col("_skipped"), F.col("_direct")), part(F.lit(0), F.col("_wrapped"))), lambda p: p["n"] > 0)
    rows = rows.withColumn("_part", F.explode(F.concat(whole, rest)))
    cut = mixing.words_from(F.col("text"), F.col("_part.first"), F.col("_part.n"))
    rows = rows.withColumn("_cut", F.col("_part.n") < F.col("_words")).withColumn("text", F.when(F.col("_cut"), cut).otherwise(F.col("text")))
    if size := next((h for h, c in names.items() if c == "n_chars"), None):
        rows = rows.withColumn(size, F.when(F.col("_cut"), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col(size)))
    return _show(rows, names, docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with ids and places, in windows of 2048 ids.

    A null or empty text is its end id alone; repeated rows are documents of their own; an
    empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The learned and hashed stages have no SQL twin; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
