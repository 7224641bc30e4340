import pytest
from pyspark.errors import PySparkException

from lectern.operators import labels


def test_clean_drops_null_and_blank_only(spark):
    df = spark.createDataFrame([(1, "好"), (None, "x"), (0, None), (0, "  "), (1, " y ")], "label int, text string")
    assert sorted(map(tuple, labels.clean(df).collect())) == [(1, " y "), (1, "好")]


def test_class_label(spark):
    df = spark.createDataFrame([("0",), ("1",), ("2",), (None,)], "label string")
    assert [tuple(x) for x in labels.class_label(df).collect()] == [(0, "negative"), (1, "positive"), (None, None), (None, None)]
    with pytest.raises(PySparkException):
        labels.class_label(df, strict=True).collect()


def test_split_is_exact_disjoint_and_stable(spark):
    df = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(1000)] + [(5000, 9)], "doc_id long, label int")
    rows = labels.stratified_split(df, fraction=0.2).collect()
    again = labels.stratified_split(df.repartition(13), fraction=0.2).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == 1001
    count = lambda c: (sum(x.label == c and x.split == "test" for x in rows), sum(x.label == c for x in rows))
    for c in (0, 1, 9):
        assert count(c)[0] == int(count(c)[1] * 0.2)


def test_labels_that_are_no_numbers(spark):
    df = spark.createDataFrame([("pos",), ("1",), ("",), ("1.5x",)], "label string")
    assert [x.label for x in labels.class_label(df).collect()] == [None, 1, None, None]
    with pytest.raises(PySparkException):
        labels.class_label(df, strict=True).collect()


def test_one_per_text_with_repeated_ids(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (1, "c"), (3, None), (4, None), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, labels.one_per_text(df).collect()), key=repr)
    assert found == sorted([(1, "a"), (2, "b"), (1, "c"), (3, None)], key=repr)


def test_one_per_text_leaves_no_text_on_both_sides(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "b", 0)], "doc_id long, text string, label int")
    assert sorted(x.doc_id for x in labels.one_per_text(df).collect()) == [1, 2]


def test_one_per_text_takes_the_first_label_there_is(spark):
    rows = [(1, "a", None), (2, "a", 1), (3, "a", 0), (4, "b", None), (5, "c", 1), (5, "c", 0), (6, "c", 0), (None, "d", 0), (7, "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    assert sorted(map(tuple, labels.one_per_text(df, label_col="label").collect())) == [(1, "a", 1), (4, "b", None), (5, "c", 0), (7, "d", 1)]


def test_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (None, 1), (1, None)], "label int, prediction int")
    assert tuple(labels.accuracy(df).first()) == (0.5, 2)
    assert tuple(labels.accuracy(df.limit(0)).first()) == (None, 0)
