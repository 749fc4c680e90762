"""A training-data pipeline in five stages: toxicity, language ID, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage is written as Parquet and read again as the
next one's docs, so a lost executor costs the stage it worked on. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import language_id, mixing, ngram_join, packing, toxicity
from tabloom.llm.common import free_name, learn_rows, small, table, work_table

#: a document whose language is this unsure is in none of the known ones
MIN_LANGUAGE_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that score THRESHOLD or more go. Learned from the labels of ``documents``."""
    labels = table(spark, sf_dir, "labels").where(learn_rows(F.col("doc_id"), 4, 2))
    scorer = toxicity.learn(toxicity.labelled_rows(table(spark, sf_dir, "documents"), labels))
    name = free_name("score", docs.columns)
    scored = toxicity.score(docs, scorer, carry=tuple(docs.columns), out=name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).drop(name)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without a letter or in no known language go."""
    model = language_id.learn(table(spark, sf_dir, "documents").where(learn_rows(F.col("doc_id"), 3, 1)))
    names = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    judged = language_id.identify(docs, model, carry=tuple(docs.columns), out=names)
    return judged.where((F.col(names[0]) != language_id.UNKNOWN) & (F.col(names[1]) >= MIN_LANGUAGE_SCORE)).drop(*names)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of the documents that copies and links connect, the one of the least id stays; of its rows with equal
    ids, one. Texts without a word belong to no group and stay. Groups are told apart by their roots, as ids may be null
    or repeat."""
    grouped = ngram_join.jaccard_join(docs)
    kept = grouped.where(F.col("key").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    # one text for each class; all its rows here have the class's id
    d, k, i, of, id_of = (free_name(n, docs.columns) for n in ("class_doc", "class_key", "class_id_hash", "own_key", "own_id_hash"))
    kept = kept.groupBy("root").agg(F.min("key").alias(k), F.first("class_id").alias(d)).select(d, k, F.xxhash64(d).alias(i))
    kept = small(work_table(kept, "kept"))
    worded = F.coalesce(_has_word(F.col("text")), F.lit(False))
    # rows equal in id and text are one before the shuffle; the join needs no other, as it is on the same two columns.
    # Copies whose ids have one hash would be one document, too: one of a group stays in any case
    rows = docs.where(worded).withColumns({of: ngram_join._key(F.col("text")), id_of: F.xxhash64("doc_id")}).dropDuplicates([id_of, of])
    one = rows.join(kept, (F.col(id_of) == F.col(i)) & (F.col(of) == F.col(k)))
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~worded))


def _has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of the mixed documents with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: learned models, MinHash and a tokenizer library have no SQL form: tests compare the stages with plain Python
ORACLE_SQL = None
