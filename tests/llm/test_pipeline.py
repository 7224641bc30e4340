from collections import Counter

import corpus_pipeline
from lectern.llm.common import staged
from tests.llm.test_jaccard_join import brute_force

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        outputs.append(docs.collect())
        assert docs.columns == columns or name == "packing"
    good, single, distinct, mixed, packed = outputs
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {x.doc_id for x in good}
    assert sum(labels[k] == 1 for k in labels if k in kept) >= 0.95 * sum(v == 1 for v in labels.values())
    best = {}
    for x in good:
        best[x.text] = max(best.get(x.text, -1), x.doc_id)
    assert sorted(x.doc_id for x in single) == sorted(best.values())
    groups = brute_force([(x.doc_id, x.text) for x in single], 5, 80, 100)
    assert sorted(x.doc_id for x in distinct) == sorted({c for _, _, c in groups})
    copies = Counter(x.doc_id for x in mixed)
    assert set(copies) == {x.doc_id for x in distinct} and max(copies.values()) <= 2
    lengths = Counter()
    for x in packed:
        lengths[x.doc_id] += x.length
        assert len(x.ids) == 4 * x.length
    assert {x.doc_id: x.doc_tokens * copies[x.doc_id] for x in packed} == dict(lengths)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length").collect())) == sorted((x.doc_id, x.start, x.length) for x in packed)
