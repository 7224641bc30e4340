import random

from lectern.functions import text
from lectern.operators import retrieval


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_search_ties_zero_vectors_and_small_corpora(spark):
    df = vectors(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 0.0, 0.0]), (7, [0.0, 1.0])])
    found = [tuple(x) for x in retrieval.search(df.filter("vec_id = 1"), df, 10).orderBy("rank").collect()]
    assert found == [(1, 2, 1.0, 1), (1, 3, 1.0, 2), (1, 7, 0.0, 3)]
    assert retrieval.search(df.filter("vec_id = 4"), df, 3).count() == 0
    assert retrieval.search(df, df.limit(0), 3).count() == 0


def test_search_over_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)]
    df = vectors(spark, rows)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 8 * 9 * 6)
    monkeypatch.setattr(retrieval, "SCORES", 100)
    small = retrieval.search(df.filter("vec_id < 20"), df.repartition(5), 4).collect()
    monkeypatch.undo()
    assert sorted(map(tuple, small)) == sorted(map(tuple, retrieval.search(df.filter("vec_id < 20"), df, 4).collect()))


def test_approximate_index_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    queries = df.filter("vec_id % 50 = 0")
    exact = {(x.query_id, x.id) for x in retrieval.search(queries, df, 5).collect()}
    found = {(x.query_id, x.id) for x in retrieval.ApproximateIndex(df).search(queries, 5, distance=1.5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_approximate_search_shuffles_neither_rows_nor_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(400)]
    df = vectors(spark, rows).repartition(4)
    index = retrieval.ApproximateIndex(df, width=0.4, tables=3)
    found = index.search(df.filter("vec_id % 50 = 0"), 4, distance=1.2)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # of a row for each table
    # by hand: rows that share a bucket in a table and lie within the distance; all rows for queries with fewer than four of them
    units = {x.id: (x.vector, x.buckets) for x in index._hashed(index.rows).collect()}
    want = []
    for q in range(0, 400, 50):
        (v, own) = units[q]
        scored = [(-round(sum(a * b for a, b in zip(v, w, strict=True)), 6), k, any(a == b for a, b in zip(own, other, strict=True))) for k, (w, other) in units.items() if k != q]
        near = sorted((s, k) for s, k, same in scored if same and 2 + 2 * s < 1.2**2)
        best = near if len(near) >= 4 else sorted((s, k) for s, k, _ in scored)
        want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(best[:4])]
    assert sorted((x.query_id, x.id, x.score, x["rank"]) for x in found.collect()) == sorted(want)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 8 * 12 * 3)
    monkeypatch.setattr(retrieval, "SCORES", 50)
    assert sorted((x.query_id, x.id, x.score, x["rank"]) for x in index.search(df.filter("vec_id % 50 = 0"), 4, distance=1.2).collect()) == sorted(want)


def test_approximate_search_gives_k_rows(spark):
    df = vectors(spark, [(1, [1.0, 0.0]), (2, [-1.0, 0.1]), (3, [-1.0, -0.2])])
    found = retrieval.ApproximateIndex(df).search(df.filter("vec_id = 1"), 2).orderBy("rank").collect()
    assert [(x.query_id, x.id, x["rank"]) for x in found] == [(1, 3, 1), (1, 2, 2)]


def test_search_against_all_pairs_with_ties(spark):
    rng = random.Random(3)
    rows = [(k, [float(rng.randint(-1, 1)) for _ in range(4)]) for k in range(400)]
    unit = {k: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v] for k, v in rows}
    want = []
    for q in range(0, 400, 50):
        scored = sorted((-round(sum(a * b for a, b in zip(unit[q], unit[k], strict=True)), 6), k) for k, v in rows if k != q and any(v) and any(dict(rows)[q]))
        want += [(q, k, -s or 0.0, n + 1) for n, (s, k) in enumerate(scored[:7])]
    df = vectors(spark, rows).repartition(7)
    assert sorted((x.query_id, x.id, x.score, x["rank"]) for x in retrieval.search(df.filter("vec_id % 50 = 0"), df, 7).collect()) == sorted(want)


def test_a_stored_index_is_loaded_and_added_to(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    retrieval.VectorIndex.save(df.filter("vec_id < 300"), f"{tmp_path}/i")
    index = retrieval.VectorIndex.load(spark, f"{tmp_path}/i")
    asked = df.filter("vec_id % 50 = 0")
    before = index.search(asked, 3).collect()
    assert before and all(x.id < 300 for x in before)
    index.add(df.filter("vec_id >= 300"))
    exact = index.search(asked, 5)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, retrieval.search(asked, df, 5).collect()))
    index.fit_projections()
    assert retrieval.recall(retrieval.VectorIndex.load(spark, f"{tmp_path}/i").approximate(asked, 5), exact).first().recall >= 0.9


def test_bm25_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, retrieval.bm25(items, docs).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 1 << 14)
    monkeypatch.setattr(retrieval, "SCORES", 50)
    assert sorted(map(tuple, retrieval.bm25(items, docs.repartition(3)).collect())) == whole


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "beta beta")], "doc_id long, text string")
    ask = lambda *x: spark.createDataFrame(list(enumerate(x)), "item_id long, text string")
    assert [x.id for x in retrieval.bm25(ask("beta"), docs).orderBy("rank").collect()] == [4, 1]
    assert retrieval.bm25(ask("gamma", None, ""), docs).count() == 0
    assert retrieval.bm25(ask("beta"), docs.limit(0)).count() == 0


def test_paragraphs_rejoin(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n "), (2, ""), (3, None), (4, "\n\n")], "doc_id long, text string")
    assert [tuple(x) for x in text.paragraphs(df).orderBy("doc_id", "pos").collect()] == [(1, 0, "a", 1), (1, 2, "b", 1)]
    papers = spark.createDataFrame([(1, "one\ntwo\n\nthree")], "doc_id long, text string")
    assert [x.para for x in text.paragraphs(papers, separator=r"\n\s*\n").orderBy("pos").collect()] == ["one\ntwo", "three"]
