"""The pipeline's stages, each against brute force over what it was given."""

from __future__ import annotations

import corpus_pipeline as P
from pyspark.sql import functions as F
from truth import decontamination_truth, near_truth

from tidemark.llm import language_id, mixing
from tidemark.llm._shared import table


def test_pipeline_of_an_empty_table_and_of_odd_rows(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    table(spark, "/root/testdata/sf0.001", "benchmark").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
    # null ids, an id of two texts, repeated rows, a very long text, and columns whose names the stages use inside
    some = docs.limit(60).withColumns({"id": F.lit(1), "key": F.lit("k"), "cls": F.lit(2), "row": F.lit(3), "__copies": F.lit(0)})
    first = docs.where("text IS NOT NULL AND length(text) > 300").orderBy("doc_id").first()
    extra = [(None, first["text"] + " and some words more that no other has", "en", "s", 0), (None, None, None, None, None), (first["doc_id"], " ".join(f"w{i % 977} and the w{i % 31}" for i in range(20_000)), "en", None, 9)]
    odd = spark.createDataFrame(extra, docs.schema).withColumns({"id": F.lit(1), "key": F.lit("k"), "cls": F.lit(2), "row": F.lit(3), "__copies": F.lit(0)})
    now = some.unionByName(odd).unionByName(some.limit(5))
    for name, stage in P.STAGES[:-1]:
        made = stage(spark, now, "/root/testdata/sf0.001")
        assert made.columns == now.columns
        now = P.materialize(made, name)
        assert now.count() > 0 and now.where("text IS NULL").count() == 0
    last = P.STAGES[-1][1](spark, now, "")
    assert last.count() == now.count()


def test_stages_do_their_work_on_all_that_came_before(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "12 !", "en", "s", 4)], docs.schema)
    docs = docs.unionByName(odd)
    rows = {"start": docs.collect()}
    for name, stage in P.STAGES:
        made = stage(spark, docs, sf)
        if name != P.STAGES[-1][0]:
            assert made.columns == docs.columns
        docs = P.materialize(made, name)
        rows[name] = docs.collect()
    ids = {k: [r["doc_id"] for r in v] for k, v in rows.items()}
    model = language_id.train(spark.createDataFrame(rows["start"], odd.schema))
    good = {r["doc_id"] for r in language_id.identify(spark.createDataFrame(rows["start"], odd.schema), model).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    assert set(ids["language_id"]) == good and not good & {-1, -2, -3}
    truth = near_truth([(r["doc_id"], r["text"]) for r in rows["language_id"]])
    assert sorted(ids["ngram_join"]) == sorted({c for _, c in truth.values()})
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    texts = [r["text"] for r in rows["ngram_join"]]
    clean = [r["doc_id"] for r, t in zip(rows["ngram_join"], decontamination_truth(texts, items), strict=True) if not t[1]]
    assert sorted(ids["decontamination"]) == sorted(clean)
    times = mixing.mix(spark.createDataFrame(rows["decontamination"], odd.schema)).collect()
    want = sorted(r["doc_id"] for r in times for _ in range(int(r["taken"] / r["size"] + 0.5) if r["size"] else 0))
    assert sorted(ids["mixing"]) == want
    assert sorted(ids["token_files"]) == want
    last = sorted(rows["token_files"], key=lambda r: r["start"])
    assert [r["doc_id"] for r in last] == want and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(last, last[1:]))
