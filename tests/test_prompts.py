from lectern.operators import prompts, providers
from lectern.plans import registry
from lectern.plans.reader import Reader


class LastLine(providers.EchoModel):
    def complete(self, prompt):
        return prompt.rsplit("\n", 1)[-1]


def test_guided_prompts_have_the_whole_text(spark):
    lines = [f"line {k}" for k in range(40)]
    df = spark.createDataFrame([(1, "\n \n".join(lines)), (2, "one"), (3, None)], "doc_id long, text string")
    rows = {(x.doc_id, x.part): x.prompt for x in prompts.guided_prompts(df).collect()}
    assert set(rows) == {(k, part) for k in (1, 2, 3) for part in prompts.PARTS}  # a document without paragraphs too
    assert rows[3, "method"] == "State the method of this paper.\n\n"
    assert rows[1, "conclusion"] == "State the conclusion of this paper.\n\n" + "\n".join(lines)


def test_guided_readings_reach_the_end(spark, tmp_path, monkeypatch):
    papers = spark.createDataFrame([(1, "\n\n".join(f"part {k}" for k in range(40)))], "doc_id long, text string")
    guide = Reader(spark, str(tmp_path), providers.HashEmbedder(), LastLine()).read_paper(papers).first().guide
    assert guide.abstract == guide.conclusion == "part 39"
    papers.write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(providers, "EchoModel", LastLine)
    assert [x.answer for x in registry.guided_reading(spark, f"{tmp_path}/in").collect()] == ["part 39"] * 4


def test_questions_without_hits_are_kept(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "beta"), (8, "nothing of it"), (9, None)], "item_id long, text string")
    rows = {x.question_id: x for x in prompts.corpus_prompts(registry.retrieval.bm25(items, docs), items, docs).collect()}
    assert set(rows) == {7, 8, 9} and [x.doc_id for x in rows[7].sources] == [1] and rows[8].sources == rows[9].sources == []
    assert rows[8].prompt == "Answer from the passages.\n\n\n\nQuestion: nothing of it"
