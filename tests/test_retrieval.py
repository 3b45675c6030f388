import math
from collections import Counter

from pyspark.sql import functions as F

from vitaeloom.operators import report
from vitaeloom.operators import retrieval as v

DOCS = [(0, "spark joins and joins"), (1, "spark streams"), (2, "the cat sat"), (3, None), (4, "spark joins"), (5, "")]


def brute_bm25(query):
    docs = {i: t.split() for i, t in DOCS if t}
    n = len(DOCS)
    df = Counter(w for t in docs.values() for w in set(t))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: r if r >= 0 else 0.25 * mean for w, r in raw.items()}
    avg = sum(map(len, docs.values())) / n
    out = {}
    for i, t in docs.items():
        tf = Counter(t)
        s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split() if w in tf)
        if s > 0:
            out[i] = s
    return sorted(out, key=lambda i: (-round(out[i], 9), i))


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    w = v.bm25_weights(v.term_counts(docs, "doc_id", "text"), docs, "doc_id")
    asked = spark.createDataFrame([(1, "spark joins joins"), (2, "cat"), (3, "nothing here"), (4, None)], "q int, question string")
    got: dict[int, list[int]] = {}
    for r in v.sparse_ranks(asked, w, "q", "doc_id", "question").orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["doc_id"])
    assert got == {1: brute_bm25("spark joins joins"), 2: brute_bm25("cat")}
    only = v.sparse_ranks(asked, w, "q", "doc_id", "question", candidates=docs.where("doc_id = 4"))
    assert [(r["q"], r["doc_id"]) for r in only.collect()] == [(1, 4)]


def test_dense_ties_and_signs(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, None)], "doc_id int, vector array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "q int, vector array<float>")
    assert [(r["doc_id"], r["rank"]) for r in v.dense_ranks(asked, docs, "q", "doc_id", most=3).orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert v.dense_ranks(asked, docs.limit(0), "q", "doc_id").count() == 0


def test_fusion_prefers_both_sides(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, doc_id int, rank int")
    sparse = spark.createDataFrame([(1, 11, 2), (1, 12, 1)], "q int, doc_id int, rank int")
    assert [r["doc_id"] for r in v.fuse(dense, sparse, "q", "doc_id").orderBy("rank").collect()] == [11, 10, 12]
    assert [r["doc_id"] for r in v.fuse(dense, None, "q", "doc_id").orderBy("rank").collect()] == [10, 11]


def test_filters(spark):
    c = spark.createDataFrame([(1, "strong_bullet", ["a"], None), (2, "platform_quirk", [], "lever"), (3, "strong_bullet", ["b"], None)], "chunk_id int, kind string, cluster_ids array<string>, platform string")
    assert [r["chunk_id"] for r in v.allowed(c, ["strong_bullet"], ["a", "z"]).collect()] == [1]
    assert [r["chunk_id"] for r in v.allowed(c, platform="lever").collect()] == [2]


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "y", 6)], "q int, kind string, rank int")
    cases = spark.createDataFrame([(1, "y"), (2, "y"), (3, "y")], "q int, want string")
    row = v.evaluate(hits, cases, F.col("kind") == F.col("want"), "q").first()
    assert (round(row["recall_at_k"], 6), round(row["mrr"], 6), row["n"]) == (0.333333, round((1 / 2 + 1 / 6) / 3, 6), 3)
    none = v.evaluate(hits, cases.limit(0), F.col("kind") == F.col("want"), "q").first()
    assert (none["recall_at_k"], none["mrr"], none["n"]) == (0.0, 0.0, 1)


def test_auc_equals_pairs(spark):
    rows = [(1, 3.0), (1, 2.0), (0, 2.0), (0, 1.0), (0, 5.0), (None, 9.0), (1, None)]
    row = v.auc(spark.createDataFrame(rows, "label int, score double")).first()
    assert (row["auc"], row["positives"], row["negatives"]) == (3 / 6, 2, 3)
    assert v.auc(spark.createDataFrame([], "label int, score double")).first()["auc"] is None


def test_context_numbers_and_weak_lines(spark):
    uses = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (2, 0, "a"), (2, 1, None)], "request_id int, pos int, chunk_id string")
    assert {(r["request_id"], r["chunk_id"], r["context_id"]) for r in report.number_context(uses).collect()} == {(1, "b", 1), (1, "a", 2), (2, "a", 1)}
    long = "one two three four five six"
    m = spark.createDataFrame([(1, 0, long, 50), (1, 1, long, 40), (1, 2, "too short", 1), (1, 3, long + " seven", 69), (1, 4, long + " eight", 70), (1, 5, None, 0)], "pair int, req_idx int, line string, score int")
    assert [(r["req_idx"], r["weak_rank"]) for r in report.weak_lines(m, "pair").orderBy("weak_rank").collect()] == [(1, 1), (3, 2)]


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "a", [2, 1, 2]), (1, "b", [9]), (1, "c", []), (1, "d", None)], "request_id int, answer_id string, ids array<int>")
    context = spark.createDataFrame([(1, 1, "one"), (1, 2, "two")], "request_id int, context_id int, text string")
    good, bad = report.ground(answers, context)
    assert [(r["answer_id"], r["grounding"]) for r in good.collect()] == [("a", ["two", "one"])]
    assert {(r["answer_id"], r["reason"]) for r in bad.collect()} == {("b", "unknown_id"), ("c", "no_context"), ("d", "no_context")}


def test_rewrites(spark):
    r = spark.createDataFrame([(1, 1, "cut costs", "cut costs by 0.97", False), (1, 2, "made it", "built it", True), (1, 3, None, "x", False)], "pair int, rewrite_no int, original_bullet string, suggested_rewrite string, readability_flag boolean")
    kept = report.guard_rewrites(r)
    assert [x["rewrite_no"] for x in kept.collect()] == [2]
    assert report.rewrite_diff(kept, "pair").first()["diff"] == "--- resume (original)\n+++ resume (suggested)\n@@ bullet 1 @@\n-made it\n+built it\n" + report.FLAG_NOTE + "\n"
    made = report.generate(kept, lambda rows: [{"pair": x["pair"], "text": x["suggested_rewrite"].upper()} for x in rows], "pair int, text string")
    assert made.first()["text"] == "BUILT IT"


def test_requests(spark):
    skills = spark.createDataFrame([("r", "p", 0, "sql", "matched", "asked sql"), ("r", "p", 1, "go", "missing_required", "asked go"), ("r", "p", 2, "x", "missing_preferred", "asked x")], "resume_id string, posting_id string, rank int, cluster_id string, state string, asked string")
    failed = spark.createDataFrame([("r", 1, "table_detected", "fail", "page 1"), ("r", 2, "text_box_detected", "pass", "")], "resume_id string, check_idx int, check_name string, status string, location string")
    clusters = spark.createDataFrame([("sql", "SQL"), ("go", "Go")], "cluster_id string, canonical_name string")
    items = report.explanation_items(skills, failed, clusters)
    assert [(r["item_id"], r["query"]) for r in items.orderBy("item_no").collect()] == [("sql", "SQL asked sql"), ("go", "Go asked go"), ("check:table_detected", "table detected page 1")]
    rows = [("equiv:sql", "equivalence", ["sql"], None, "asked sql"), ("b1", "strong_bullet", ["sql"], None, "wrote sql"), ("b2", "strong_bullet", ["go"], None, "asked go sql"), ("q1", "platform_quirk", [], "lever", "table page"), ("q2", "platform_quirk", [], "ashby", "table detected page 1"), *((f"z{i}", "strong_bullet", ["x"], None, "none") for i in range(6))]
    chunks = spark.createDataFrame(rows, "chunk_id string, kind string, cluster_ids array<string>, platform string, text string")
    weights = v.bm25_weights(v.term_counts(chunks, "chunk_id", "text"), chunks, "chunk_id")
    ranks = v.filtered_ranks(report.with_filters(items, F.lit("lever")), chunks, weights, 2, "resume_id", "posting_id", "item_no")
    got = [(r["item_id"], r["chunk_id"]) for r in report.item_context(items, chunks, ranks).orderBy("pos").collect()]
    assert got == [("sql", "equiv:sql"), ("sql", "b1"), ("go", "b2"), ("check:table_detected", "q1")]


def test_fused_query_ranks_fifty_documents_a_side(spark, tmp_path):
    import numpy as np

    from vitaeloom.plans import queries

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 6))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    texts = {i: " ".join(rng.choice(list("abcdefghijklmnopqrst"), 6)) for i in range(120)}
    spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(vectors)], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights = v.bm25_weights(v.term_counts(docs, "doc_id", "text"), docs, "doc_id")
    sparse: dict[int, dict[int, int]] = {}
    for r in v.sparse_ranks(docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "q"), weights, "q", "doc_id", "text", most=50).collect():
        sparse.setdefault(r["q"], {})[r["doc_id"]] = r["rank"]
    got: dict[int, list[int]] = {}
    for r in queries.rrf_topk(spark, str(tmp_path)).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["doc_id"])
    narrow = 0
    for q in range(0, 400, 20):
        cosine = np.round(vectors[list(texts)].astype(np.float32).astype(float) @ vectors[q].astype(np.float32).astype(float), 9)
        order = [int(i) for i in np.argsort(-cosine, kind="stable") if cosine[i] > 0]
        top = []
        for depth in (50, 20):
            sides = [{i: n + 1 for n, i in enumerate(order[:depth])}, {i: n for i, n in sparse.get(q, {}).items() if n <= depth}]
            score = {i: sum(1 / (60 + s[i]) for s in sides if i in s) for i in {*sides[0], *sides[1]}}
            top.append(sorted(score, key=lambda i: (-round(score[i], 12), i))[:5])
        assert got[q] == top[0]
        narrow += top[0] != top[1]
    assert narrow > 0


def test_rewrite_context(spark):
    ranks = spark.createDataFrame([("r", 0, "b", 1), ("r", 0, "a", 2), ("r", 1, "a", 1), ("r", 1, "c", 2), ("s", 5, "z", 1)], "req string, item int, chunk_id string, rank int")
    got = {(r["req"], r["item"]): r["ids"] for r in report.rewrite_context(ranks, "req", "item", "g").collect()}
    assert got == {("r", 0): [2, 3, 1], ("r", 1): [3, 4, 1], ("s", 5): [2, 1]}
    assert report.rewrite_context(ranks, "req", "item").where("item = 1").first()["ids"] == [2, 3]


def test_equal_items_are_ranked_once_within_their_clusters(spark):
    held = [(f"c{i:03}", "ab"[i % 2], [["x"], ["y"], ["x", "y"], [], None, ["x", None]][i % 6], [None, "lever"][i % 5 == 0], f"made some w{i % 7} {'w3 ' * (i % 3)}") for i in range(240)]
    chunks = spark.createDataFrame(held, "chunk_id string, kind string, cluster_ids array<string>, platform string, text string")
    weights = v.bm25_weights(v.term_counts(chunks, "chunk_id", "text"), chunks, "chunk_id")
    forms = [("some w3", ["a"], ["y", "x"], None), ("some w3 w3", ["a", "b"], ["y"], None), ("some made w1", [], [], "lever"), ("w2", ["b"], ["z"], None), ("some w3", ["a"], ["x"], None), ("", [], [], None), (None, [], [], None)]
    asked = [(n, k, *forms[n % 7]) for n in range(140) for k in (0, 1)]
    items = spark.createDataFrame(asked, "req int, item int, query string, kinds array<string>, cluster_ids array<string>, platform string")
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages)}

    weight = {(r["chunk_id"], r["term"]): r["weight"] for r in weights.collect()}
    old = set(written())
    got = {(r["req"], r["item"], r["rank"]): (r["chunk_id"], r["score"]) for r in v.filtered_ranks(items, chunks, weights, 3, "req", "item").collect()}
    assert sum(n for k, n in written().items() if k not in old) < 12_000
    want = {}
    for req, item, query, kinds, clusters, platform in asked:
        fits = [c for c, kind, own, place, _ in held if (not kinds or kind in kinds) and (not clusters or set(clusters) & set(own or ()) - {None}) and platform in (None, place)]
        scores = sorted((-round(sum(weight.get((c, t), 0) for t in (query or "").split()), 9), c) for c in fits)
        want |= {(req, item, i + 1): (c, -s) for i, (s, c) in enumerate([x for x in scores if x[0] < 0][:3])}
    assert {k: (c, round(s, 6)) for k, (c, s) in got.items()} == {k: (c, round(s, 6)) for k, (c, s) in want.items()}
