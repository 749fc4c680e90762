"""Mixing sources to target weights by systematic sampling.

Targets: the sources, in code point order with null last, get shares of the whole size by weight; no target exceeds
``max_repeats`` times its source's size, and the excess goes to the others by weight until none is above. That is water
filling, and it has a closed form: sorted by size / weight, a prefix of the sources is full and the rest share what
remains.

Sampling: each document expects r = target / source size copies. Documents of a source stand in a fixed order (size
class, salt of the document, doc_id), so that the prefix sum of expected copies of the document of rank k is r * (k + 1).
With one offset u of the source it is emitted once for each integer in (r * k + u, r * (k + 1) + u]: floor(r) or ceil(r)
times. As the order runs through the sizes, the taken words come near the target.

The rank needs no task that holds a whole source: documents are counted by (source, size class), a class gets a salt for
each CELLS-th of all documents that it holds, and the prefix sums of the cells' counts are added to the row number within
the cell. So there are at most CELLS cells more than classes, and none has much more than a CELLS-th of the documents.
Ranks are made of ids, sizes and digests; whole rows are joined with their copies afterwards.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source of size 0 has target 0
and nothing is taken; repeated rows and equal doc_ids are documents of their own (equal rows are interchangeable);
null doc_ids come first in their cell; an empty table gives an empty result; clashing extra columns are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words_of, small, table, work_table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
#: size classes of one source are halves of powers of two; a cell is a CELLS-th of all documents, but not under MIN_CELL
CELLS, MIN_CELL = 20_000, 256
_STEPS = 1 << 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row for each source comes in and goes out.

    The windows without keys run over sources, not documents: one task holds a few numbers for each source, which is
    meant for up to some millions of sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (nth + 1).cast("int")).cast("bigint")
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    w = w.withColumn("total", F.sum("source_size").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    w = w.withColumn("level", level)
    # the first source that is not full at its level fixes the level of all that follow
    open_level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.when(F.col("cap") <= F.coalesce(open_level, F.lit(float("inf"))) * F.col("weight"), F.col("cap").cast("double")).otherwise(open_level * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def _digest(*parts: Column) -> Column:
    """The first 15 hex digits of md5 as bigint: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("bigint")


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: str, key: str) -> DataFrame:
    """(doc_id, source, size, digest, source_size, target, copies)"""
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    size = F.col("size")
    half = F.when(size > 0, F.floor(F.log2(size.cast("double")) * 2)).otherwise(F.lit(-1)).cast("int")
    sized = docs.select(F.col(key).alias("doc_id"), F.col("source").cast("string").alias("source"), n_words_of(F.col("text")).alias("size"), digest_of(F.col(key), F.col("text"), seed).alias("digest"))
    sized = work_table(sized.withColumn("class", half), "sized")
    classes = work_table(sized.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    salts = classes.select("source", "class", F.ceil(F.col("n") / max(MIN_CELL, -(-total // CELLS))).cast("bigint").alias("salts"))
    goal = small(work_table(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats), "targets"))
    same = lambda a, b, cols: _all([a[c].eqNullSafe(b[c]) for c in cols])
    few = small(work_table(salts, "salts"))
    salted = sized.join(few, same(sized, few, ["source", "class"])).select(*[sized[c] for c in sized.columns], (F.col("digest") % F.col("salts")).alias("salt"))
    cells = work_table(salted.groupBy("source", "class", "salt").agg(F.count("*").alias("n")), "cells")
    in_source = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    placed = cells.join(goal, same(cells, goal, ["source"]), "left").select(cells["source"], "class", "salt", "before", "source_size", "target")
    placed = small(work_table(placed, "placed"))
    at = Window.partitionBy("source", "class", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "size", "digest")
    ranked = salted.withColumn("row", F.row_number().over(at) - 1)
    j = ranked.join(placed, same(ranked, placed, ["source", "class", "salt"]), "left").select(*[ranked[c] for c in ranked.columns], "before", "source_size", "target")
    rank = (F.col("before") + F.col("row")).cast("double")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = (_digest(F.lit(f"{seed}/"), name) % _STEPS).cast("double") / _STEPS  # a multiple of 2^-20: sums with ranks are exact
    copies = F.least(F.floor(r * (rank + 1) + u) - F.floor(r * rank + u), F.lit(max_repeats))
    return j.select("doc_id", "source", "size", "digest", "source_size", "target", copies.cast("bigint").alias("copies"))


def digest_of(key: Column, text: Column, seed: str = SEED) -> Column:
    """What a document's salt is taken from; ties of id and size stand in its order."""
    return _digest(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): copies is how often the mix takes the document."""
    return _mixed(docs, weights, max_repeats, seed, key).drop("digest")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the texts are shuffled once.

    Rows are joined with their copies by id, source and text. Rows equal in these share the copies of their group: as
    many each as divide evenly, and one more for the first ones."""
    mixed = _mixed(docs, weights, max_repeats, seed, key)
    # two hashes, of 124 bits together, stand for id, source and text; rows and window are dealt out by them alone
    copies = mixed.groupBy(F.xxhash64("doc_id", "source", "digest").alias("_g"), F.col("digest").alias("_h")).agg(F.sum("copies").alias("_t"), F.count("*").alias("_m")).where("_t > 0")
    whole = docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in docs.columns], digest_of(F.col(key), F.col("text"), seed).alias("_x"))
    whole = whole.withColumn("_y", F.xxhash64(F.col(f"c_{key}"), F.col("c_source").cast("string"), F.col("_x")))
    both = whole.join(copies, (F.col("_y") == F.col("_g")) & (F.col("_x") == F.col("_h")))
    first = Window.partitionBy("_y", "_x").orderBy(*[F.xxhash64(f"c_{c}") for c in docs.columns if c not in (key, "source", "text")] or [F.lit(0)])
    n = F.when(F.col("_m") == 1, F.col("_t")).otherwise(F.floor(F.col("_t") / F.col("_m")) + (F.row_number().over(first) <= F.col("_t") % F.col("_m")).cast("bigint")).cast("int")
    out = both.withColumn("_n", n).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('{SEED}' || coalesce(doc_id::VARCHAR, '') || md5(coalesce(text, ''))), 1, 15))::BIGINT AS digest FROM documents),
c AS (SELECT *, CASE WHEN size > 0 THEN floor(log2(size) * 2)::INT ELSE -1 END AS class FROM d),
k AS (SELECT *, digest % ceil(count(*) OVER (PARTITION BY source, class) / greatest({MIN_CELL}, ceil(count(*) OVER () / {CELLS})))::BIGINT AS salt FROM c),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([{", ".join(map(str, WEIGHTS))}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight,
             {MAX_REPEATS} * source_size AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
o AS (SELECT min(level) AS level FROM (SELECT level FROM l WHERE cap > level * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1)),
t AS (SELECT source, source_size, CASE WHEN cap <= coalesce(o.level, 'inf'::DOUBLE) * weight THEN cap::DOUBLE ELSE o.level * weight END AS target FROM l, o),
r AS (SELECT k.*, t.source_size, t.target, (row_number() OVER (PARTITION BY k.source ORDER BY class, salt, doc_id NULLS FIRST, size, digest) - 1)::DOUBLE AS rnk,
             CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END AS ratio,
             (('0x' || substr(md5('{SEED}/' || coalesce('=' || k.source, 'null')), 1, 15))::BIGINT % {_STEPS})::DOUBLE / {_STEPS} AS u
      FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (size * least(floor(ratio * (rnk + 1) + u) - floor(ratio * rnk + u), {MAX_REPEATS}))::BIGINT AS taken FROM r"""
