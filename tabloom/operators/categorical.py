"""Categorical encoders, the category cross, and target-aware encoders with out-of-fold forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import cat, md5_bucket, num
from .registry import Operator, register

RARE = "__RARE__"


def _hash_encode(c: Column, n_buckets: int = 16, seed: int = 0) -> Column:
    return F.when(c.isNotNull(), md5_bucket(F.concat(F.lit(f"{seed}:"), c), n_buckets))


def _ordinal_true_scale(c: Column, order: tuple[str, ...] = ()) -> Column:
    if not order:
        return F.lit(None).cast("int")
    scale = F.create_map(*[F.lit(v) for i, name in enumerate(order) for v in (name, i)])
    return F.try_element_at(scale, c)


def _cross(a: Column, b: Column) -> Column:
    part = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    return F.concat(part(a), F.lit("|"), part(b))


register(Operator("hash_encode", "categorical", ("categorical",), "low_cardinality_categorical", build=_hash_encode, defaults={"n_buckets": 16, "seed": 0}))
register(Operator("ordinal_true_scale", "categorical", ("categorical",), "ordinal", build=_ordinal_true_scale, defaults={"order": ()}))
register(Operator("category_cross", "categorical_interaction", ("categorical", "categorical"), "high_cardinality_categorical", build=_cross))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(_cat, _n) of the trimmed non-blank categories."""
    return df.select(cat(column).alias("_cat")).where("_cat IS NOT NULL").groupBy("_cat").agg(F.count("*").alias("_n"))


def _joined(df: DataFrame, column: str, state: DataFrame) -> DataFrame:
    return df.withColumn("_c", cat(column)).join(state, F.col("_c") == F.col("_cat"), "left")


def _fit_one_hot(df: DataFrame, columns: list[str], params: dict) -> list[str]:
    top = value_counts(df, columns[0]).orderBy(F.desc("_n"), "_cat").limit(params.get("max_categories", 100))
    return [r[0] for r in top.collect()]  # max_categories rows


def _apply_one_hot(df: DataFrame, columns: list[str], params: dict, state: list[str], out: str) -> DataFrame:
    c = cat(columns[0])
    return df.withColumn(out, F.array(*[F.coalesce(c == v, F.lit(False)) for v in state]).cast("array<boolean>"))


def ranked_by_count(counts: DataFrame) -> DataFrame:
    """(_cat, _n, _rank): 0 for the most frequent, ties in value order. Ranks come from counts of counts and a rank within
    each count, so no window runs over all categories."""
    sizes = counts.groupBy("_n").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("_n").orderBy("_cat")
    ranked = counts.withColumn("_r", F.row_number().over(within) - 1).join(sizes.select("_n", before.alias("_before")), "_n")
    return ranked.select("_cat", "_n", (F.col("_before") + F.col("_r")).cast("int").alias("_rank"))


def _map_encoder(name: str, fit, value, output: str = "continuous_numeric", **more) -> None:
    def apply(df: DataFrame, columns: list[str], params: dict, state: DataFrame, out: str) -> DataFrame:
        return _joined(df, columns[0], state).select(*df.columns, value(F.col("_c"), params).alias(out))

    register(Operator(name, "categorical", ("categorical",), output, shape="fitted", fit=fit, apply=apply, leakage="L1", **more))


def _fit_frequency(df: DataFrame, columns: list[str], params: dict) -> DataFrame:
    """Shares of all rows, those without a category included."""
    total = df.agg(F.count("*").alias("total")).first()[0]
    return value_counts(df, columns[0]).select("_cat", (F.col("_n") / F.lit(max(1, total))).alias("_n"))


register(Operator("one_hot", "categorical", ("categorical",), "vector", shape="fitted", fit=_fit_one_hot, apply=_apply_one_hot, defaults={"max_categories": 100}, leakage="L1", null_policy="defined"))
_map_encoder("ordinal_encode", lambda df, cols, p: ranked_by_count(value_counts(df, cols[0])), lambda c, p: F.when(c.isNotNull(), F.coalesce("_rank", F.lit(-1))), "ordinal")
_map_encoder("frequency_encode", _fit_frequency, lambda c, p: F.when(c.isNotNull(), F.coalesce("_n", F.lit(0.0))))
_map_encoder("count_encode", lambda df, cols, p: value_counts(df, cols[0]), lambda c, p: F.when(c.isNotNull(), F.coalesce("_n", F.lit(0))), "count")
_map_encoder(
    "rare_group",
    lambda df, cols, p: value_counts(df, cols[0]).where(F.col("_n") >= p.get("min_count", 5)),
    lambda c, p: F.when(F.col("_n").isNotNull(), c).when(c.isNotNull(), F.lit(RARE)),
    "low_cardinality_categorical",
    defaults={"min_count": 5},
)


# ---- with the target -------------------------------------------------------------------------------------------------


def _sums(df: DataFrame, c: Column, y: Column) -> DataFrame:
    """(_cat, _n, _s, _pos, _neg) over rows with a target."""
    rows = df.select(c.alias("_cat"), y.alias("_y")).where("_y IS NOT NULL")
    return rows.groupBy("_cat").agg(F.count("*").alias("_n"), F.sum("_y").alias("_s"), F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") == 0).alias("_neg"))


def smoothed_mean(n: Column, s: Column, prior: Column, smoothing: float) -> Column:
    return (s + smoothing * prior) / (n + smoothing)


def weight_of_evidence(pos: Column, neg: Column, all_pos: Column, all_neg: Column, s: float) -> Column:
    share = lambda a, b: F.greatest((a + s) / (b + 2 * s), F.lit(1e-6))
    return F.when(pos.isNotNull() & neg.isNotNull(), F.log(share(pos, all_pos) / share(neg, all_neg)))


def _fit_target(df: DataFrame, columns: list[str], params: dict) -> DataFrame:
    """The sums of each category, and the totals in every row."""
    per = _sums(df, cat(columns[0]), num(columns[1])).where("_cat IS NOT NULL")
    total = df.select(num(columns[1]).alias("y")).agg(F.avg("y"), F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    return per.select("*", *[F.lit(v).cast("double").alias(k) for k, v in zip(("_prior", "_all_pos", "_all_neg"), total, strict=True)])


def _apply_target_mean(df: DataFrame, columns: list[str], params: dict, state: DataFrame, out: str) -> DataFrame:
    v = smoothed_mean(F.col("_n"), F.col("_s"), F.col("_prior"), params.get("smoothing", 10.0))
    return _joined(df, columns[0], state).select(*df.columns, v.alias(out))


def _apply_woe(df: DataFrame, columns: list[str], params: dict, state: DataFrame, out: str) -> DataFrame:
    v = weight_of_evidence(F.col("_pos"), F.col("_neg"), F.col("_all_pos"), F.col("_all_neg"), params.get("smoothing", 10.0))
    return _joined(df, columns[0], state).select(*df.columns, v.alias(out))


def equal_width_bin(x: Column, lo: float | None, hi: float | None, n_bins: int) -> Column:
    if lo is None or hi is None or lo == hi:
        return F.when(x.isNotNull(), F.lit(0))
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.floor((x - lo) / (hi - lo) * n_bins), F.lit(n_bins - 1))).cast("int"))


def _fit_binned(df: DataFrame, columns: list[str], params: dict) -> tuple[float | None, float | None, DataFrame]:
    x, y, bins, s = num(columns[0]), num(columns[1]), params.get("n_bins", 5), params.get("smoothing", 10.0)
    lo, hi, prior = df.where(y.isNotNull()).agg(F.min(x), F.max(x), F.avg(F.when(x.isNotNull(), y))).first()
    per = _sums(df, equal_width_bin(x, lo, hi, bins), y).where("_cat IS NOT NULL")
    value = F.lit(0.0) if lo == hi else smoothed_mean(F.col("_n"), F.col("_s"), F.lit(prior), s)
    return lo, hi, per.select("_cat", value.alias("_value"))


def _apply_binned(df: DataFrame, columns: list[str], params: dict, state: tuple, out: str) -> DataFrame:
    lo, hi, per = state
    joined = df.withColumn("_c", equal_width_bin(num(columns[0]), lo, hi, params.get("n_bins", 5))).join(per, F.col("_c") == F.col("_cat"), "left")
    return joined.select(*df.columns, F.col("_value").alias(out))


register(Operator("target_mean_crossfit", "target_aware", ("categorical", "target"), "continuous_numeric", shape="fitted", fit=_fit_target, apply=_apply_target_mean, defaults={"smoothing": 10.0}, leakage="L2"))
register(Operator("woe_crossfit", "target_aware", ("categorical", "target"), "continuous_numeric", shape="fitted", fit=_fit_target, apply=_apply_woe, defaults={"smoothing": 10.0}, leakage="L2"))
register(Operator("numeric_to_cat_target", "target_aware", ("continuous_numeric", "target"), "continuous_numeric", shape="fitted", fit=_fit_binned, apply=_apply_binned, defaults={"n_bins": 5, "smoothing": 10.0}, leakage="L2"))


def out_of_fold_mean(df: DataFrame, column: str, target: str, fold: str, out: str, smoothing: float = 1.0) -> DataFrame:
    """df with the smoothed target mean of the row's category over all other folds; unseen there: the prior, which is the
    mean of the other folds as well. Sums by (category, fold) are the only thing shuffled besides the join."""
    c, y, zero, none = cat(column), num(target), F.lit(0), F.lit(0.0)
    rows = df.select(c.alias("_cat"), F.col(fold).alias("_f"), y.alias("_y")).where("_y IS NOT NULL")
    per = rows.groupBy("_cat", "_f").agg(F.count("*").alias("_n"), F.sum("_y").alias("_s"))
    folds = per.groupBy("_f").agg(F.sum("_n").alias("_fn"), F.sum("_s").alias("_fs"))
    all_n, all_s = folds.agg(F.sum("_fn"), F.sum("_fs")).first()
    whole = per.where("_cat IS NOT NULL").groupBy("_cat").agg(F.sum("_n").alias("_cn"), F.sum("_s").alias("_cs"))
    j = df.withColumn("_c", c)
    j = j.join(whole, F.col("_c") == F.col("_cat"), "left").drop("_cat")
    own = per.select(F.col("_cat").alias("_oc"), F.col("_f").alias("_of"), "_n", "_s")
    j = j.join(own, (F.col("_c") == F.col("_oc")) & (F.col(fold) == F.col("_of")), "left")
    j = j.join(folds.withColumnRenamed("_f", "_ff"), F.col(fold) == F.col("_ff"), "left")
    n = F.coalesce("_cn", zero) - F.coalesce("_n", zero)
    s = F.coalesce("_cs", none) - F.coalesce("_s", none)
    prior = (F.lit(all_s) - F.coalesce("_fs", none)) / F.nullif(F.lit(all_n) - F.coalesce("_fn", zero), zero)
    return j.select(*df.columns, F.when(F.col("_c").isNotNull(), smoothed_mean(n, s, prior, smoothing)).alias(out))
