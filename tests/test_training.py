from lectern.operators import providers, training
from lectern.sources import arxiv, files


def reviews(spark):
    good, bad = ["great book", "nice phone"], ["bad book", "poor phone"]
    return spark.createDataFrame([(f"{(bad, good)[k % 2][k // 2 % 2]} {k}", k % 2) for k in range(80)], "text string, label int")


def test_the_best_of_more_and_more_rounds_is_saved(spark, tmp_path):
    rows = reviews(spark)
    found = training.fit_best(rows, rows, f"{tmp_path}/m", rounds=(1, 3, 10))
    assert found[10] <= found[3] <= found[1]
    model = files.load_best(f"{tmp_path}/m")
    assert abs(training.losses({"x": model}, rows)["x"] - min(found.values())) < 1e-9
    assert training.devices(spark, 2) in (["cpu"], ["cuda"])


def test_log_losses_and_ties(spark):
    df = spark.createDataFrame([("b", 1, 0.9), ("a", 1, 0.9), ("c", 1, 0.5), ("c", None, 0.1), ("d", 0, 1.0)], "model string, label int, positive double")
    found = {x.model: (x.loss, x.best) for x in training.log_losses(df).collect()}
    assert [k for k, x in found.items() if x[1]] == ["a"] and found["c"][0] == 0.693147181 and found["d"][0] > 30


def test_word_vectors_are_trained_on_the_corpus(spark, tmp_path):
    rows = [f"the {a} {b} in the house" for a in ("cat", "dog") for b in ("sleeps", "eats", "plays")] * 30 + [f"{a} {b} money at the bank" for a in ("people", "firms") for b in ("save", "lend", "owe")] * 30
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)] + [(9999, None)], "chunk_id long, para string")
    own = providers.WordVectors(16, rounds=3).fit(df)
    own.save(f"{tmp_path}/v")
    found = providers.embed(df, providers.WordVectors.load(f"{tmp_path}/v"))
    assert found.columns == ["chunk_id", "para", "embedding"] and found.count() == len(rows) + 1
    vector = {x.para: list(x.embedding) for x in found.collect()}
    near = lambda a, b: sum(x * y for x, y in zip(vector[a], vector[b], strict=True)) / (sum(x * x for x in vector[a]) * sum(x * x for x in vector[b])) ** 0.5
    assert near("the cat sleeps in the house", "the dog eats in the house") > near("the cat sleeps in the house", "firms lend money at the bank")
    assert vector[None] == [0.0] * 16


def test_encoding_with_a_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([("Good book, great!",), (None,)], "text string")
    rows = providers.encode(df, providers.FileTokenizer(path), max_length=12).collect()
    want = Tokenizer.from_file(path).encode("Good book, great!").ids
    assert list(rows[0].input_ids)[: len(want)] == want and sum(rows[0].attention_mask) == len(want)


def test_download_by_many_tasks_keeps_to_one_limit(spark):
    listed = spark.createDataFrame([(str(k), f"http://pdf/{k}" if k != 3 else "http://pdf/gone") for k in range(4)] + [("x", None)], "paper_id string, pdf_url string")
    rows = {x.paper_id: x for x in arxiv.download(listed, tasks=2, per_second=1000, retries=1, fetcher="tests.fetch_stub:fetch").collect()}
    assert len(rows) == 5 and bytes(rows["0"].content) == b"%PDF http://pdf/0" and rows["x"].content is None
