"""Document fingerprints by winnowing.

The code points' k-grams are hashed by a rolling polynomial; of each window of w consecutive grams the least hash is
chosen, the rightmost of equal ones, and kept with its position. Any common passage of w + k - 1 code points gives both
texts a common hash. Likeness of two fingerprints is 2 x common / (sum of both), over distinct hashes.

A text shorter than k is one gram. Defined cases: null text is empty; an empty text has an empty fingerprint, which is
alike (1.0) to another empty one and unlike (0.0) anything else; equal texts have equal fingerprints; repeated rows give
repeated results; an empty table gives an empty result. For the successor of a document, rows stand in the order of
(doc_id, text hash), null ids first, and the last is followed by the first (a single row by itself).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, arrow_batches, map_rows, table

K, WINDOW = 12, 16
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from the text, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    k = min(k, len(codes))
    n = len(codes) - k + 1
    rolled = codes[:n].copy()
    for j in range(1, k):
        rolled *= _BASE
        rolled += codes[j : n + j]
    rolled ^= rolled >> np.uint64(32)
    rolled *= _MIX
    rolled &= ~_LOW  # the upper half is the hash; the lower one makes later positions smaller, so ties go right
    rolled |= _LOW - np.arange(n, dtype=np.uint64)
    least, span, want = rolled, 1, min(window, n)
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    kept = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (kept >> np.uint64(32)).astype(np.uint32), (_LOW - (kept & _LOW)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """a, b: distinct hashes, sorted."""
    if not len(a) and not len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    return hashlib.blake2b(hashes.astype("<u4").tobytes() + positions.astype("<i8").tobytes(), digest_size=16).hexdigest()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """(doc_id, marks): the chosen (hash, pos) of every whole text, in text order."""
    kind = dict(docs.dtypes)[key]

    def make():
        def apply(rows: dict) -> dict:
            marks = []
            for t in rows["text"]:
                h, p = winnow(t or "", k, window)
                marks.append([{"hash": a, "pos": b} for a, b in zip(h.tolist(), p.tolist(), strict=True)])
            return {"doc_id": rows[key], "marks": marks}

        return apply

    return map_rows(docs.select(key, "text"), make, f"doc_id {kind}, marks array<struct<hash: bigint, pos: bigint>>")


def with_successors(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(bucket, tail, id, text) in partitions sorted so that each row is followed by its successor.

    Buckets are ranges of ids. The first row of a bucket goes to the bucket before it as well, as its tail row, so no
    partition needs another one. Only range bounds and the first id of each bucket, two numbers a bucket, reach the driver."""
    spark = docs.sparkSession
    n = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = -(1 << 63)
    ids = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(lowest)).alias("oid"), F.col(key).alias("id"), "text")
    cuts = np.unique(np.asarray(ids.approxQuantile("oid", [i / n for i in range(1, n)], 0.2 / n), np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def bucket_of(oid: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, oid.to_numpy(), side="right").astype(np.int32))

    placed = ids.withColumn("bucket", bucket_of("oid"))
    firsts = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.min("oid")).collect())
    tails = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]  # the first bucket follows the last
    if not tails:
        tails = [(lowest, 0)]
    first = F.broadcast(spark.createDataFrame(tails, "oid bigint, before int"))  # one row a bucket
    homes = F.array(F.struct(F.col("bucket"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail")))
    rows = placed.join(first, "oid", "left").withColumn("home", F.explode(F.filter(homes, lambda h: h["bucket"].isNotNull())))
    rows = rows.select("home.bucket", "home.tail", "oid", "id", "text")
    return rows.repartition(n // 4, "bucket").sortWithinPartitions("bucket", "tail", "oid", F.xxhash64("text"))


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """Per row: the fingerprint of its text and of its edited text (the last quarter replaced by the start of the
    successor's text), and how alike it is to the latter and to the successor's fingerprint."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    rows = with_successors(docs, key)
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_marks bigint"
    out_schema = _arrow_schema(spark, schema)
    arrow_batches(spark)

    def run(batches):
        held = None  # (bucket, id, text, hashes, distinct hashes, positions) of the row whose successor is awaited
        closed = None  # the bucket whose tail was read
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in out_schema}
            for bucket, tail, _, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tail and bucket == closed:
                    continue
                text = text or ""
                h, p = winnow(text, k, window)
                now = (bucket, doc, text, h, np.unique(h), p)
                if held is not None:
                    _, was, old, h0, u0, p0 = held
                    m = min(len(old) // 4, len(text))
                    edited = old[: len(old) - len(old) // 4] + text[:m]
                    he, pe = winnow(edited, k, window)
                    values = (was, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(h0, p0), digest(he, pe), likeness(u0, np.unique(he)), likeness(u0, now[4]), len(h0))
                    for f, v in zip(out_schema, values, strict=True):
                        out[f.name].append(v)
                held = None if tail else now
                closed = bucket if tail else closed
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in out_schema], schema=out_schema)

    return rows.mapInArrow(run, schema)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
