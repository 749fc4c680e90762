"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of five-word shingles (64-bit hashes); two texts are linked if their Jaccard similarity is at least 0.8.

1. Copies. Equal texts are one class (key: md5 of the text); all that follows is done once for each class.
2. Candidates. 128 MinHash values in 32 bands of 4: two texts of similarity 0.8 share no band with probability 5e-8. Keys of
   bands are counted before anything is brought together, and only bands of two or more texts go on.
3. Pruning. In each band group MinHash values are compared 16, then 32, 64 and 128 at a time; with a uniform prior and
   m of n equal values the similarity has a Beta(m + 1, n - m + 1) posterior, and a pair is dropped when the probability
   that it reaches 0.8 falls below TOLERANCE. What is left is reduced to a spanning forest of each group.
4. Verification. The candidate components meet once more, with their whole shingle sets: pruned pairs are compared exactly.
   Of a component only per-text link counts and a spanning forest leave a task: no pairs are written.

Groups larger than a block are split: a text has a block by hash, and each pair of blocks is a task group of its own, so
a group of any size never meets in one task. A text is copied once for each block of its group. Blocks grow with their
group, so there are about 64 of them at most: up to 4 million texts that share a band (then one more for each 65,536), up to
half a million different texts in one component of candidates (then one more for each 8,192 texts or 32 MB). Up to there
what is shuffled is at most 64 times the rows; beyond, it grows with the square of the one group. The comparisons in a
group of g different texts are of order g squared at any size, as exact link counts need them; copies do not count, as
they are one text. Keys that many rows have (bands, components, copies) are dealt out in joins.

Defined cases: texts without a word (null, empty, white space) link to nothing and are classes of their own; texts of
fewer than five words are one shingle; copies with equal texts share a class without a link; ties take the least id;
rows of equal doc_id are told apart by text; null doc_ids are members like others (class_id is null only if all ids of
the class are null); an empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, arrow_batches, map_rows, small, spread_join, table, work_table
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEPS = (16, 32, 64, 128)
TOLERANCE = 1e-9
#: blocks of a group: (fewest rows, most rows, bytes); between the bounds a block is a 64th of the group
BLOCK, VERIFY_BLOCK, BLOCKS = (1024, 65_536, 1 << 40), (128, 8192, 32 << 20), 64
#: pairs of so many texts by so many are compared at a time
SUB_BLOCK = 1024

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and _BASE^-i modulo 2^64 for i < n."""
    if len(cache.get("up", ())) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(size, _U)
            done = 1
            while done < size:
                step = _U(pow(base, done, 1 << 64))
                p[done : 2 * done] = p[: min(done, size - done)] * step
                done *= 2
            cache[name] = p
    return cache["up"], cache["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CACHE: dict = {}


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted; words are runs of anything but ASCII white space."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, _U)
    up, down = _powers(len(data) + 1, _CACHE)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U)))
    words = _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(_U) * _U(0xD6E8FEB86659FD93))
    k = min(size, len(words))
    n = len(words) - k + 1
    out = words[:n].copy()
    for j in range(1, k):
        out = out * _U(_BASE) + words[j : n + j]
    return np.unique(_mix(out + _U(k)))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * HASHES + 1, dtype=_U) * _U(_BASE))
    return (x[:HASHES] >> _U(32)).astype(np.uint32) | np.uint32(1), (x[HASHES:] >> _U(32)).astype(np.uint32)


def signature(grams: np.ndarray) -> bytes:
    """128 MinHash values of 32 bits."""
    a, b = _seeds()
    x = (grams >> _U(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i : i + 1024, None] * a + b).min(axis=0), out=least)
    return least.tobytes()


def fewest_equal(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest of n equal values with which a pair is kept: P[Beta(m + 1, n - m + 1) >= t] = P[Bin(n + 1, t) <= m]."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


KEEP = tuple((n, fewest_equal(n)) for n in STEPS)


def candidates(sig: np.ndarray, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of rows, j of others, i < j if both are the same) that pruning keeps; ``sig`` is (texts, 128)."""
    same = rows is others
    left, right = [], []
    first, least = KEEP[0]
    for at, i in enumerate(rows):
        js = others[at + 1 :] if same else others
        js = js[(sig[js, :first] == sig[i, :first]).sum(axis=1) >= least]
        for (n0, _), (n1, m) in zip(KEEP, KEEP[1:], strict=False):
            if not len(js):
                break
            if n1 == KEEP[1][0] or len(js):
                js = js[(sig[js, :n1] == sig[i, :n1]).sum(axis=1) >= m]
        if len(js):
            left.append(np.full(len(js), i))
            right.append(js)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _find(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _join_sets(up: list[int], left: np.ndarray, right: np.ndarray) -> None:
    """Union-find: the least member is the root of a set."""
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = _find(up, a), _find(up, b)
        if a != b:
            up[max(a, b)] = min(a, b)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """True for the pairs whose exact Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(left) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.int64)
    else:  # many pairs: intersections as products of 0/1 matrices, over the shingles of two or more texts, in blocks
        owner = np.repeat(np.arange(len(sets)), sizes)
        grams, nth, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(n > 1) - 1
        keep = n[nth] > 1
        owner, column = owner[keep], place[nth[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        counts = np.zeros((len(sets), len(sets)), np.float32)
        width, total = 4096, int((n > 1).sum())
        for start in range(0, total, width):
            a, b = np.searchsorted(column, (start, start + width))
            x = np.zeros((len(sets), min(width, total - start)), np.float32)
            x[owner[a:b], column[a:b] - start] = 1
            counts += x @ x.T
        both = counts[left, right].astype(np.int64)
    return both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9


def _groups(batches, n_keys: int):
    """Lists of rows (tuples) with equal first ``n_keys`` columns, from sorted batches."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:n_keys] != now:
                if rows:
                    yield rows
                now, rows = row[:n_keys], []
            rows.append(row)
    if rows:
        yield rows


def _tiled(rows: DataFrame, group: str, block: tuple[int, int, int], carry: list[str]) -> DataFrame:
    """(group, ti, tj, blk, key, carried): a row goes to each pair of blocks that its own block is in, and the pairs are
    dealt out as groups of their own. ``n`` and ``bytes`` are the rows and bytes of the row's group."""
    fewest, most, size = block
    each = F.least(F.lit(most), F.greatest(F.lit(fewest), F.col("n") / BLOCKS))
    n = F.greatest(F.ceil(F.col("n") / each), F.ceil(F.col("bytes") / size)).cast("int")
    own = F.pmod(F.xxhash64("key"), n).cast("int")
    placed = rows.withColumn("blk", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    tiles = placed.select(group, F.least("blk", "other").alias("ti"), F.greatest("blk", "other").alias("tj"), "blk", "key", *carry)
    # the pairs of blocks of a group are counted through, so they fall into as many partitions as there are
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nth = F.expr("tj * (cast(tj AS bigint) + 1) div 2 + ti")
    at = F.pmod(F.pmod(F.xxhash64(group), F.lit(partitions)) + nth, F.lit(partitions)).cast("int")
    return tiles.repartitionById(partitions, at).sortWithinPartitions(group, "ti", "tj", "key")


def _parts(rows: np.ndarray, others: np.ndarray):
    """The pairs of SUB_BLOCK rows and others at most; of a set and itself each pair of parts once."""
    same = rows is others
    cut = [rows[i : i + SUB_BLOCK] for i in range(0, len(rows), SUB_BLOCK)]
    if not same:
        yield from ((a, others[j : j + SUB_BLOCK]) for a in cut for j in range(0, len(others), SUB_BLOCK))
    else:
        yield from ((a, b) for i, a in enumerate(cut) for b in cut[i:])


def _sides(rows: list[tuple], ti: int, tj: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    if ti == tj:
        every = np.arange(len(rows))
        return every, every
    blk = np.array([r[at] for r in rows])
    return np.flatnonzero(blk == ti), np.flatnonzero(blk == tj)


def _candidate_edges(tiles: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the kept pairs of each tile."""
    spark = tiles.sparkSession
    schema = "a binary, b binary"
    out_schema = _arrow_schema(spark, schema)
    arrow_batches(spark)

    def run(batches):
        a, b = [], []
        for rows in _groups(batches, 3):
            _, ti, tj = rows[0][:3]
            sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).reshape(len(rows), HASHES)
            up: list[int] = list(range(len(rows)))
            for some, others in _parts(*_sides(rows, ti, tj, 3)):
                _join_sets(up, *candidates(sig, some, others))
            for i in range(len(rows)):
                root = _find(up, i)
                if i != root:
                    a.append(rows[i][4])
                    b.append(rows[root][4])
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=out_schema)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=out_schema)

    return tiles.mapInArrow(run, schema)


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): for each text of a tile its links there and the root of its set of linked texts."""
    spark = tiles.sparkSession
    schema = "a binary, b binary, links bigint"
    out_schema = _arrow_schema(spark, schema)
    arrow_batches(spark)

    def run(batches):
        for rows in _groups(batches, 3):
            _, ti, tj = rows[0][:3]
            grams = [shingles(r[5]) for r in rows]
            sig = np.frombuffer(b"".join(map(signature, grams)), np.uint32).reshape(len(rows), HASHES)
            links = np.zeros(len(rows), np.int64)
            up: list[int] = list(range(len(rows)))
            for some, others in _parts(*_sides(rows, ti, tj, 3)):
                left, right = candidates(sig, some, others)
                if not len(left):
                    continue
                at = some if some is others else np.concatenate((some, others))
                place = np.empty(len(rows), np.int64)
                place[at] = np.arange(len(at))
                good = linked([grams[i] for i in at], place[left], place[right], threshold)
                left, right = left[good], right[good]
                np.add.at(links, left, 1)
                np.add.at(links, right, 1)
                _join_sets(up, left, right)
            at = np.flatnonzero(links).tolist()
            if at:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[i][4] for i in at], pa.binary()), pa.array([rows[_find(up, i)][4] for i in at], pa.binary()), pa.array(links[at])], schema=out_schema
                )

    return tiles.mapInArrow(run, schema)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, n_links, key, root) of every row: class_id is the least id among all documents that links and copies
    connect, n_links the number of other texts (copies count once) of similarity ``threshold`` or more. root is the class
    itself, the least key of its texts: ids may be null or repeat in other classes, a root does not.

    ``threshold`` may be raised; candidates are found for 0.8 and above."""
    if threshold < THRESHOLD:
        raise ValueError(f"candidates are made for similarities of {THRESHOLD} or more")
    kind = dict(docs.dtypes)[key]
    texts = docs.select(F.col(key).alias("doc_id"), "text", _key(F.col("text")).alias("key"))

    def make():
        def apply(rows: dict) -> dict:
            out: dict[str, list] = {"doc_id": rows["doc_id"], "key": [], "sig": []}
            known: dict[bytes, bytes | None] = {}
            for k, t in zip(rows["key"], rows["text"], strict=True):
                if k is not None and k not in known:
                    grams = shingles(t)
                    known[k] = signature(grams) if len(grams) else None
                sig = known.get(k)
                out["key"].append(k if sig is not None else None)
                out["sig"].append(sig)
            return out | {"size": [len(t or "") for t in rows["text"]]}

        return apply

    members = work_table(map_rows(texts, make, f"doc_id {kind}, key binary, sig binary, size bigint"), "members")
    keyed = members.where("key IS NOT NULL")
    # one row for each different text: combined before the shuffle, so copies are no hot task
    each = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("sig").alias("sig"), F.min("size").alias("size"))
    each = work_table(each, "texts")
    n_texts, n_rows = each.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    band = F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)]))
    bands = each.select("key", band.alias("band"))
    busy = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("rows", F.col("n"))
    shared = work_table(spread_join(bands, busy, "band", "rows", BANDS * n_texts, ["key"]).withColumn("bytes", F.lit(0)), "bands")
    tiles = _tiled(shared.join(each.select("key", "sig"), "key"), "band", BLOCK, ["sig"])
    found = components(_candidate_edges(tiles)).withColumnRenamed("node", "key")
    found = work_table(found.join(each.select("key", "doc_id", "size"), "key"), "candidates")
    groups = found.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("rows", F.col("n"))
    wanted = spread_join(found, groups, "root", "rows", n_texts, ["key"])
    wanted = small(work_table(wanted.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "root", "n", "bytes"), "wanted"))
    # the whole texts of one document for each candidate; rows that are equal in id and text are one
    again = texts.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    again = again.select("key", "root", "n", "bytes", "text").dropDuplicates(["key"])
    verified = work_table(_verified(_tiled(again, "root", VERIFY_BLOCK, ["text"]), threshold), "links")
    links = verified.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("n_links"))
    roots = components(verified.select("a", "b")).select(F.col("node").alias("key"), "root")
    classes = each.select("key", "doc_id", "copies").join(roots, "key", "left").join(links, "key", "left")
    classes = work_table(classes.select("key", F.coalesce("root", "key").alias("root"), "doc_id", "copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "classes")
    least = classes.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows"))
    classes = work_table(spread_join(classes.drop("doc_id"), least, "root", "rows", n_texts, ["key"]), "roots")
    out = spread_join(keyed.select("doc_id", "key"), classes, "key", "copies", n_rows, ["doc_id"])
    alone = members.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), "key", F.lit(None).cast("binary").alias("root"))
    return out.select("doc_id", "class_id", "n_links", "key", "root").unionByName(alone)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("key", "root")
