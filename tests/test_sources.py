from lectern.operators import labels, providers
from lectern.plans import sentiment
from lectern.plans.reader import Reader
from lectern.sources import files
from lectern.sources.arxiv import ArxivSource
from lectern.streaming import ingest


def test_reviews_are_read_as_meant(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_bytes(b"\xef\xbb\xbf" + 'cat,label,review\n书籍,1,"很好, 推荐"\n手机,0,"一行\n又一行"\n水果,1,"他说""好"""\n酒店,,\n'.encode())
    rows = [tuple(x) for x in files.read_reviews(spark, str(path)).collect()]
    assert rows == [("书籍", "1", "很好, 推荐"), ("手机", "0", "一行\n又一行"), ("水果", "1", '他说"好"'), ("酒店", None, None)]
    kept = labels.clean(labels.class_label(labels.drop_column(files.read_reviews(spark, str(path)))), "review")
    assert kept.columns == ["label", "review", "label_name"] and kept.count() == 3


def test_pdf_bytes_and_parser_errors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"one\n\ntwo")
    (tmp_path / "sub/b.pdf").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = files.read_pdfs(spark, str(tmp_path))
    assert sorted(bytes(x.content) for x in rows.collect()) == [b"one\n\ntwo", b"\xff\xfe"]
    parsed = providers.parse_pdfs(rows.select("path", "content"), providers.PlainTextParser()).collect()
    assert {(x.text, bool(x.error)) for x in parsed} == {("one\n\ntwo", False), (None, True)}


def test_download_source(spark):
    spark.dataSource.register(ArxivSource)
    df = spark.read.format("arxiv").options(query="all:x", max_results=7, page_size=2, pause_seconds=0, fetcher="tests.fetch_stub:fetch").load()
    rows = {x.paper_id: x for x in df.collect()}
    assert sorted(rows) == list("01234") and rows["0"].title == "Paper 0" and bytes(rows["4"].content) == b"%PDF http://pdf/4"
    assert rows["3"].content is None and "gone" in rows["3"].error


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0], "train"), (2, [0.25, 2.0], "test")], "vec_id long, embedding array<double>, split string")
    files.write_embeddings(df, f"{tmp_path}/e")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/e").collect())) == [(1, [0.5, 1.0]), (2, [0.25, 2.0])]
    files.write_dataset(df, f"{tmp_path}/d")
    assert [x.vec_id for x in files.read_dataset(spark, f"{tmp_path}/d", "test").collect()] == [2]
    files.write_chunks(df, f"{tmp_path}/j", json=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_sentiment_run(spark, tmp_path):
    good, bad = ["质量好", "great book", "很喜欢"], ["质量差", "bad phone", "不喜欢"]
    lines = [f"书籍,1,{good[k % 3]} {k}" for k in range(60)] + [f"手机,0,{bad[k % 3]} {k}" for k in range(60)]
    (tmp_path / "r.csv").write_text("cat,label,review\n" + "\n".join(lines) + "\n", encoding="utf-8")
    found = sentiment.run(spark, str(tmp_path / "r.csv"), str(tmp_path / "out"), regularisations=(0.0, 10.0))
    assert found["accuracy"] > 0.9 and found["best"] == "regularisation=0.0" and found["device"] in ("cpu", "cuda")
    from lectern.operators import training

    model = files.load_best(found["model"])
    one = training.predict(model, "great book", "review").first()
    batch = training.predict(model, spark.createDataFrame([(7, "great book"), (8, None)], "id int, review string"), "review").orderBy("id").collect()
    assert one.prediction == batch[0].prediction == 1 and abs(one.positive - batch[0].positive) < 1e-12 and len(batch) == 2
    assert training.select_best({"b": 0.3, "a": 0.3, "c": 0.5}) == "a"


def test_encode(spark):
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "好", "书", "read", "##ing", "!"]
    df = spark.createDataFrame([("好书 Reading!",), ("x",), (None,)], "text string")
    rows = providers.encode(df, providers.WordPiece(vocabulary), max_length=8).collect()
    assert list(rows[0].input_ids) == [2, 4, 5, 6, 7, 8, 3, 0] and list(rows[0].attention_mask) == [1] * 7 + [0]
    assert list(rows[1].input_ids)[:3] == [2, 1, 3] and list(rows[2].input_ids)[:2] == [2, 3]
    assert list(providers.encode(df, providers.WordPiece(vocabulary), max_length=3).first().input_ids) == [2, 4, 3]


def test_reader(spark, tmp_path):
    papers = spark.createDataFrame([(1, "Spark joins.\n\nShuffles move rows.", "A"), (2, "Cats sleep.\n\n \n\nDogs bark.", "B"), (3, None, "C")], "doc_id long, text string, title string")
    reader = Reader(spark, str(tmp_path / "store"), providers.HashEmbedder(), providers.EchoModel())
    reader.build(papers)
    assert spark.read.parquet(f"{tmp_path}/store/papers").columns == ["doc_id", "title"] and spark.read.parquet(f"{tmp_path}/store/chunks").count() == 4
    asked = spark.createDataFrame([(5, "Dogs bark."), (6, "shuffles move rows.")], "item_id long, text string")
    answers = {x.question_id: x for x in reader.answer(asked, k=2).collect()}
    assert answers[5].prompt.startswith("Answer from the passages.\n\n[1] Dogs bark.") and answers[6].prompt.split("\n")[2] == "[1] Shuffles move rows."
    assert answers[5].prompt.endswith("Question: Dogs bark.") and answers[5].answer == "Answer from the passages." and answers[5].sources[0].score == 1.0
    guide = reader.read_paper(papers.filter("doc_id = 1")).first().guide
    assert guide.abstract == "State the abstract of this paper." and guide.conclusion == "State the conclusion of this paper."


def test_papers_that_keep_arriving(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"one\n\ntwo")

    def run():
        stream = ingest.new_papers(spark, str(tmp_path / "in"), providers.PlainTextParser())
        ingest.append_paragraphs(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
        return sorted(x.para for x in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["one", "two"]
    (tmp_path / "in/b.pdf").write_bytes(b"three")
    assert run() == ["one", "three", "two"]
