"""The pipeline's stages, each on what the one before it left."""

from collections import Counter

import corpus_pipeline

from boscage.llm import jaccard, lines, suffix, tables


def test_stages(spark, tmp_path):
    base = "\n".join(" ".join(f"w{i * 13 % 101}{chr(97 + (i * j) % 26)}{j}" for i in range(12)) for j in range(12))
    rows = [(i, base.replace("w", f"v{i}x"), "en", "s", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1].replace("v1x13", "changed"), "en", "s", 0), (102, "spam " * 300, "en", "s", 0), (103, None, "en", "s", 0), (104, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = str(tmp_path / name)
        stage(spark, before, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id for r in docs.collect()} >= set(range(60)), name
        if name == "quality_rules":
            assert not {r.doc_id for r in docs.collect()} & {102, 103, 104}
        if name == "line_dedup":
            assert 100 not in {r.doc_id for r in docs.collect()}
            assert lines.line_classes(docs).where("not kept").count() == 0
        if name == "jaccard_join":
            assert jaccard.jaccard_groups(docs).where("component_id <> doc_id").count() == 0
        if name == "suffix_dedup":
            assert suffix.repeated_spans(docs).where("n_dropped > 0").count() == 0
    assert Counter(r.doc_id for r in docs.collect()).keys() >= set(range(60))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rk long, gone string, `group` string"
    text = lambda i: "\n".join(" ".join(f"q{i}x{j}y{k * 7 % 13}z{k}" for k in range(9 + j % 3)) for j in range(9))
    rows = [(i, text(i), "en", None, 1, i, "x", "g") for i in range(55)]
    rows += [(None, text(90), "en", None, 1, None, None, None), (7, text(7), "en", None, 1, 7, "x", "g"), (91, " \n\t", "en", None, 1, None, None, None)]
    folder = tmp_path / "odd"
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
        assert docs.columns == spark.createDataFrame([], schema).columns
    found = Counter(r.doc_id for r in docs.collect())
    assert found[7] == 2 and found[None] == 1 and found[91] == 0 and set(range(55)) <= found.keys()
    none = tmp_path / "none"
    spark.createDataFrame([], schema).write.parquet(str(none / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0


def test_only_rewritten_rows_move(spark, tmp_path):
    rows = [(i, f"a {i}\nb", "x") for i in range(5000)] + [(7, "a 7\nb", "y"), (None, "only", "z"), (8, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    named = docs.selectExpr("doc_id", "xxhash64(doc_id, text) rk", "array(0) lines").where("text = 'only' or doc_id in (7, 9, 4999)").distinct()
    named.write.parquet(str(tmp_path / "named"))
    named = spark.read.parquet(str(tmp_path / "named"))
    some, rest = tables.parted(docs.selectExpr("*", "xxhash64(doc_id, text) rk"), "rk", named, "rk")
    ids = Counter(r.doc_id for r in some.collect())
    assert ids[7] == 2 and ids[None] == ids[9] == ids[4999] == 1 and some.count() < 300 and some.count() + rest.count() == len(rows)
    got = Counter(tuple(r) for r in tables.rewritten(docs, named, "lines", lines._cut, "text", "doc_id").collect())
    want = [(d, "b" if d in (7, 9, 4999) else t, g) for d, t, g in rows if t != "only"]
    assert got == Counter(want)
