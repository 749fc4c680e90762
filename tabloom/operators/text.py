"""Text measures, signed feature hashing and TF-IDF."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import char_ngrams, md5_bucket, txt, word_tokens
from .registry import Operator, register


def _measure(name: str, build, output: str = "continuous_numeric") -> None:
    register(Operator(name, "text", ("free_text",), output, build=build))


def _share(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern)) / F.greatest(F.length(t), F.lit(1))


def _upper(t: Column) -> Column:
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return F.when(t.isNotNull(), F.when(letters > 0, F.regexp_count(t, F.lit(r"\p{IsUppercase}")) / F.nullif(letters, F.lit(0))).otherwise(F.lit(0.0)))


def tokens(t: Column, ngram: int = 1) -> Column:
    return word_tokens(t) if ngram <= 1 else char_ngrams(t, ngram)


def _hashing(t: Column, n_features: int = 16, ngram: int = 1, seed: int = 0) -> Column:
    """Each token adds +1 or -1 to its bucket. Tokens become signed bucket numbers, and a number is counted by the drop in
    length when it is removed, which is a tight loop over integers; nothing is exploded or shuffled."""
    bucket = lambda w: md5_bucket(F.concat(F.lit(f"{seed}:"), w), n_features) + 1
    sign = lambda w: 1 - 2 * md5_bucket(F.concat(F.lit(f"s:{seed}:"), w), 2)
    signed = F.transform(tokens(F.coalesce(t, F.lit("")), ngram), lambda w: bucket(w) * sign(w))

    def counts(s: Column) -> Column:
        removed = [(F.size(F.array_remove(s, F.lit(-b).cast("bigint"))) - F.size(F.array_remove(s, F.lit(b).cast("bigint")))).cast("bigint") for b in range(1, n_features + 1)]
        return F.array(*removed)

    return F.transform(F.array(signed), counts)[0]


_measure("text_length_chars", lambda t: F.length(t), "count")
_measure("text_length_tokens", lambda t: F.size(word_tokens(t)), "count")
_measure("text_digit_ratio", lambda t: _share(t, r"\p{Nd}"))
_measure("text_upper_ratio", _upper)
_measure("text_punctuation_ratio", lambda t: _share(t, r"\p{Punct}"))
register(Operator("text_hashing", "text", ("free_text",), "vector", build=_hashing, defaults={"n_features": 16, "ngram": 1, "seed": 0}, null_policy="defined"))


def fit_tfidf(df: DataFrame, columns: list[str], params: dict) -> list[tuple[str, float]]:
    """[(token, idf)]: the max_features tokens most documents have, ties in code point order. Tokens are made distinct in
    the row before they are counted, so that a document adds one row for each."""
    t, ngram, top = txt(columns[0]), params.get("ngram", 1), params.get("max_features", 100)
    docs = df.select(t.alias("t")).where("t IS NOT NULL")
    n = docs.count()
    df_counts = docs.select(F.explode(F.array_distinct(tokens(F.col("t"), ngram))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    best = df_counts.orderBy(F.desc("n"), "w").limit(top)
    idf = F.log((1.0 + F.lit(n)) / (1.0 + F.col("n"))) + 1.0
    return [(r[0], r[1]) for r in best.select("w", idf).collect()]  # max_features rows


def apply_tfidf(df: DataFrame, columns: list[str], params: dict, state: list[tuple[str, float]], out: str) -> DataFrame:
    """Tokens are counted by the vocabulary's hash table in one pass over them; texts without a token, and null, give zeros."""
    if not state:
        return df.withColumn(out, F.array().cast("array<double>"))
    words, idf = [w for w, _ in state], F.array(*[F.lit(v) for _, v in state])
    base = df.withColumn("_w", F.coalesce(tokens(txt(columns[0]), params.get("ngram", 1)), F.array().cast("array<string>")))
    counted = CountVectorizerModel.from_vocabulary(words, inputCol="_w", outputCol="_counts").transform(base)
    # the row's numbers are bound once: a lambda would evaluate what stands in it for each entry of the vector
    row = F.array(F.struct(F.size("_w").alias("n"), vector_to_array("_counts").alias("c")))
    value = F.transform(row, lambda r: F.zip_with(r["c"], idf, lambda c, i: F.when(r["n"] > 0, c / r["n"] * i).otherwise(F.lit(0.0))))[0]
    return counted.withColumn(out, value).drop("_w", "_counts")


for _name, _ngram in (("tfidf_word", 1), ("tfidf_char", 3)):
    register(
        Operator(
            _name, "text_representation", ("free_text",), "vector", shape="fitted", leakage="L1", null_policy="defined", defaults={"max_features": 100, "ngram": _ngram},
            fit=lambda df, c, p, k=_ngram: fit_tfidf(df, c, {"ngram": k} | p), apply=lambda df, c, p, s, out, k=_ngram: apply_tfidf(df, c, {"ngram": k} | p, s, out),
        )
    )
