from lectern.llm import licenses


def test_variants_of_a_licence_are_one(spark):
    mit = licenses.LICENCES["MIT"]
    variants = [
        mit,
        "Copyright (c) 2019 Some One\n\n" + mit,
        "© 2001-2003 Ünal & Co.\nAll rights reserved.\n" + mit.upper(),
        mit.replace("sublicense", "sub-licence").replace('"', "”").replace(" ", "  ").replace(", ", ",\n"),
    ]
    other = [mit + " And more.", "", None, "Copyright 2020 X", "x " * 100000]
    df = spark.createDataFrame([(k, x, 1, "n") for k, x in enumerate(variants + other)], "doc_id long, text string, digest int, notices string")
    rows = {x.doc_id: x for x in licenses.scan(df).collect()}
    assert [rows[k].licence for k in range(len(variants))] == ["MIT"] * len(variants)
    assert all(rows[k].licence is None and rows[k].n_notices == 0 and rows[k].notices is None for k in range(len(variants), len(rows)))
    assert len({rows[k].canonical_sha256 for k in range(len(variants))}) == 1
    assert rows[5].canonical_sha256 == rows[6].canonical_sha256 == rows[7].canonical_sha256


def test_titles_and_copyright_lines(spark):
    heads = ["MIT License\n\nCopyright (c) 2020 Some One\n\n", "The MIT License (MIT)\n", "Copyright Foo Bar 2020\n", "Portions Copyright 1999, 2001 by A B\nCopyright © 2003\n", "MIT Licence\nCopyright <YEAR> <COPYRIGHT HOLDER>\n"]
    other = ["GPL License\n", "MIT License or so\n", "Copyright law applies\n"]
    df = spark.createDataFrame([(k, x + licenses.LICENCES["MIT"]) for k, x in enumerate(heads + other)], "doc_id long, text string")
    found = {x.doc_id: x.licence for x in licenses.scan(df).collect()}
    assert [found[k] for k in range(8)] == ["MIT"] * 5 + [None] * 3


def test_the_query_finds_whole_texts(spark):
    from lectern.llm.queries import license_files, op10_license_scan

    rows = {x.doc_id: x.licence for x in op10_license_scan(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == 200 + len(license_files())
    for k, x in license_files():
        assert (rows[k] is None) == x.endswith("with one more condition"), x[:100]


def test_notices_and_repeats(spark):
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0."), (2, "released under the MIT License"), (2, "released under the MIT License"), (3, "It is released under the MIT License.")], "doc_id long, text string")
    rows = sorted((x.doc_id, x.licence or "", x.notices or "", x.n_notices) for x in licenses.scan(df).collect())
    assert rows == [(1, "", "CC-BY-NC-4.0,MIT", 3), (2, "MIT", "MIT", 1), (2, "MIT", "MIT", 1), (3, "", "", 0)]
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, licences={"own": ["It is released, under the MIT license"]}, notices={}).filter("licence = 'own'").count() == 1


def test_no_python_on_the_main_path(spark):
    plan = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_long_licences_are_known(spark):
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"]
    texts = [licenses.LICENCES[x] for x in names]
    df = spark.createDataFrame([(k, "Copyright 2020 X\n" + x.replace("\n\n", "\n \n\n")) for k, x in enumerate(texts)] + [(99, texts[2] + " more")], "doc_id long, text string")
    found = {x.doc_id: x.licence for x in licenses.scan(df).collect()}
    assert found == dict(enumerate(names)) | {99: None}
