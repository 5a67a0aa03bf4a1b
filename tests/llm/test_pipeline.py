"""The stages of the pipeline, each on what its predecessor kept, against plain versions."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import secrets


def test_stages(spark, tmp_path):
    r = random.Random(8)
    en = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    text = lambda: " ".join(r.choices(en, k=60))
    item = text()
    rows = [(k, text(), "en", f"s{k % 3}", 1) for k in range(40)]
    copy = rows[3][1].split()
    copy[10] = "other"
    rows += [(100, "12 34 !!", None, "s0", 8), (101, None, None, "s0", None), (102, " ".join(copy), None, "s1", 1), (103, rows[3][1], "en", "s1", 1), (104, f"{text()} {item} {text()}", "en", "s2", 1), (105, f'{text()} token = "{"1f" * 20}" {text()}', "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_lang": F.lit(1), "matches": F.lit(2), "a.b": F.lit(3)}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept.append(docs)
        if name != "mixing sources":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_lang", "matches", "a.b"]
    ids = [{x.doc_id for x in d.collect()} for d in kept]
    assert ids[0] == {k for k, *_ in rows} - {100, 101}
    assert ids[1] == ids[0] - {102, 103}
    assert ids[2] == ids[1] - {104} == ids[3] == ids[4]
    masked = kept[3].filter("doc_id = 105").first()
    assert secrets.MASK in masked.text and "1f1f" not in masked.text and masked.n_chars == len(masked.text)
    assert {x.doc_id: x.text for x in kept[3].collect() if x.doc_id != 105} == {x.doc_id: x.text for x in kept[2].collect() if x.doc_id != 105}
    again = {(x.doc_id, x.taken) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {(x.doc_id, x.taken) for x in kept[4].collect()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
