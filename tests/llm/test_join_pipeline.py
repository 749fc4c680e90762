"""Operator 10 and the pipeline against brute force, and the subpackage's place in the repository."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import common, language_id, ngram_join, toxicity
from tabloom.llm.common import learn_rows, table
from tabloom.llm.components import components

SF = "/root/testdata/sf0.001"


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{(id, text): (class id, links)}"""
    texts = sorted({t for _, t in rows if shingle_set(t)})
    sets = [shingle_set(t) for t in texts]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(texts)))
    for _ in texts:
        for i in list(links):
            root[i] = min([root[i], *[root[j] for j in links[i]]])
    at = {t: i for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        if t in at and d is not None:
            least[root[at[t]]] = min(d, least.get(root[at[t]], d))
    return Counter((d, least.get(root[at[t]]) if t in at else d, len(links[at[t]]) if t in at else 0) for d, t in rows)


def near_copies(seed, groups, size):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(400)]
    out, i = [], 100
    for _ in range(groups):
        words = [r.choice(vocabulary) for _ in range(r.randint(6, 120))]
        for _ in range(r.randint(1, size)):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append((i, r.choice([" ", "\n"]).join(w)))
            i += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_join_equals_brute_force(spark, documents, odd, monkeypatch, small):
    """``small``: blocks of a few rows or bytes, pairs in parts of two by two, and every key with two rows is a hot one."""
    if small:
        monkeypatch.setattr(ngram_join, "BLOCK", (4, 5, 1 << 40))
        monkeypatch.setattr(ngram_join, "VERIFY_BLOCK", (3, 6, 2000))
        monkeypatch.setattr(ngram_join, "SUB_BLOCK", 2)
        monkeypatch.setattr(common, "HOT_ROWS", 1)
    rows = [*odd, *near_copies(5 + small, 25, 14), (50, "a b c"), (51, "a  b c"), (52, "a b d")]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_join(documents(rows)).collect())
    assert got == brute(rows)


def test_join_finds_every_pair_of_the_test_documents(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    texts = {t: set(shingle_set(t)) for (t,) in docs.select("text").distinct().collect() if t and shingle_set(t)}
    places, both = defaultdict(list), Counter()
    names = list(texts)
    for i, t in enumerate(names):
        both.update((j, i) for s in texts[t] for j in places[s])
        for s in texts[t]:
            places[s].append(i)
    links = Counter()
    for (i, j), n in both.items():
        if n >= 0.8 * (len(texts[names[i]]) + len(texts[names[j]]) - n) - 1e-9:
            links.update((names[i], names[j]))
    got = ngram_join.jaccard_join(docs).groupBy("doc_id").agg(F.max("n_links").alias("n")).join(docs.select("doc_id", "text"), "doc_id")
    assert sum(links.values()) > 0 and all(links[r.text] == r.n for r in got.collect())


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    per = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    out = common.spread_join(rows, per, "k", "n", 1000, ["v"])
    assert out.columns == ["k", "v", "top"] and out.count() == 1000 and out.where("k = 0").select("top").distinct().collect()[0][0] == 999
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in rows.join(per.drop("n"), "k").collect()}


def test_work_tables_need_a_shared_folder_and_can_be_cleared(spark, tmp_path, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    assert common.work_table(spark.range(5), "five").count() == 5
    assert list(tmp_path.rglob("*.parquet"))
    common.clear_work_tables(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_join_of_nothing(spark, documents):
    assert ngram_join.jaccard_join(documents([])).count() == 0
    assert [tuple(r)[:3] for r in ngram_join.jaccard_join(documents([(1, None), (2, " ")])).orderBy("doc_id").collect()] == [(1, 1, 0), (2, 2, 0)]


def test_shingles_are_sets_of_five_words():
    r = random.Random(4)
    words = ["a", "b", "é", "dd", "e?"]
    seen = {}
    for _ in range(300):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
        got = frozenset(ngram_join.shingles(t).tolist())
        assert len(got) == len(shingle_set(t)) and seen.setdefault(shingle_set(t), got) == got
    assert len(set(seen.values())) == len(seen)


def test_verification_by_matrices_and_by_pairs_agree():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**63, 90).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, 80, replace=False), r.integers(0, 2**63, 3).astype(np.uint64)])) for _ in range(40)]
    left, right = np.array([(i, j) for i in range(40) for j in range(i)]).T
    pairs = np.array([bool(ngram_join.linked(sets, left[k : k + 1], right[k : k + 1])[0]) for k in range(len(left))])
    assert (ngram_join.linked(sets, left, right) == pairs).all() and 0 < pairs.sum() < len(pairs)


def test_pruning_keeps_what_may_reach_the_threshold():
    from math import comb

    for n, m in ngram_join.KEEP:
        tail = sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m))
        assert tail < ngram_join.TOLERANCE  # what is dropped had less than this chance
        assert m > 0.2 * n - 8 or n == 16


def test_components(spark):
    r = random.Random(6)
    edges = [(f"{r.randrange(300):03}", f"{r.randrange(300):03}") for _ in range(260)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(70)] + [("x", "x"), ("x", None)]
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {a: find(a) for a in up}


# ---- pipeline ----------------------------------------------------------------------------------------------------------


def test_stages_keep_their_promises(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    (_, toxic), (_, known), (_, one), (_, mixed), (_, packed) = corpus_pipeline.STAGES
    a = toxic(spark, docs, SF)
    scorer = toxicity.learn(toxicity.labelled_rows(docs, table(spark, SF, "labels").where(learn_rows(F.col("doc_id"), 4, 2))))
    clean = {r.doc_id for r in docs.collect() if scorer.score(r.text) < toxicity.THRESHOLD}
    assert a.columns == names and {r.doc_id for r in a.collect()} == clean and len(clean) > 150
    b = known(spark, a, SF)
    model = language_id.learn(docs.where(learn_rows(F.col("doc_id"), 3, 1)))
    kept = {r.doc_id for r in a.collect() if (j := model.judge(r.text))[0] != "und" and j[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    assert b.columns == names and {r.doc_id for r in b.collect()} == kept
    c = one(spark, b, SF).cache()
    rows = [(r.doc_id, r.text) for r in b.collect()]
    want = sorted(d for (d, cls, _), n in brute(rows).items() if d == cls)
    assert c.columns == names and sorted(r.doc_id for r in c.collect()) == want
    d = mixed(spark, c, SF).cache()
    copies = Counter(r.doc_id for r in d.collect())
    assert d.columns == names and max(copies.values()) <= 3 and set(copies) <= set(want)
    e = packed(spark, d, SF)
    got = Counter(r.doc_id for r in e.where("piece = 0").collect())
    assert got == copies and e.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_one_of_each_group_with_odd_rows(spark, documents, odd):
    docs = documents([*odd, (None, "same text here"), (8, "same text here too")])
    kept = sorted((str(r.doc_id), (r.text or "")[:20]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect())
    ids = [i for i, _ in kept]
    assert ids.count("6") == 1 and "7" not in ids and all(str(i) in ids for i in (1, 2, 3, 4, 5, 8))


def test_null_and_repeated_ids_keep_unlinked_texts(spark, documents):
    rows = [(None, "one text of no id"), (None, "quite another without an id"), (5, "first words under five"), (5, "other things under five"), (5, "first words under five")]
    rows += [(None, "shared by both"), (7, "shared by both"), (9, "shared by both")]
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, documents(rows), SF).collect())
    assert kept == Counter([*rows[:4], (7, "shared by both")])


def test_stages_take_columns_of_any_names(spark):
    docs = table(spark, SF, "documents").limit(60)
    odd = docs.withColumns({c: F.lit(f"own {c}") for c in ("score", "Lang_Pred", "class_doc", "class_key", "own_key", "key", "root", "_n", "size", "copies")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        assert all(r.score == "own score" and r.own_key == "own own_key" and r["copies"] == "own copies" for r in out.collect())


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    for f in (root / "tabloom").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d", n)} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names and {"op1_quality_rules", "op4_mixing", "op7_url_filters"} <= set(entry.oracle_sql())
