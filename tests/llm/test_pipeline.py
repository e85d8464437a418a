
from pyspark.sql import functions as F

import corpus_pipeline
from vigilake.llm import toxicity
from vigilake.llm.common import cut, table
from vigilake.llm.queries import toxicity_field

from .test_dedup import lines_by_hand, near_by_hand
from .test_formats import check_packing
from .test_models import found_by_hand

SF01 = "/root/testdata/sf0.01"


def test_stages_match_plain_versions(spark):
    docs = table(spark, SF01, "documents")
    columns, held = docs.columns, docs
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = cut(stage(spark, held, SF01), f"test-{name}")
        assert held.columns == columns
        out[name] = {r.doc_id: r for r in held.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity_field(spark, docs, SF01)).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert set(out["toxicity"]) == {i for i, s in scores.items() if s < 0.5}
    clean = lines_by_hand([(i, rows[i]) for i in out["toxicity"]])
    assert {i: r.text for i, r in out["line_dedup"].items()} == {i: t for i, t in clean.items() if t or not rows[i]}
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"].values())
    classes = near_by_hand([(i, r.text) for i, r in out["line_dedup"].items()])
    assert set(out["near_duplicates"]) == {i for i, (c, _) in classes.items() if i == c}
    bench = [(r.item_id, r.text) for r in table(spark, SF01, "benchmark").collect()]
    gone = set(out["near_duplicates"]) - set(out["decontamination"])
    assert gone and gone == {i for i, _ in found_by_hand([(i, out["near_duplicates"][i].text) for i in gone], bench)}
    packed = corpus_pipeline.run(spark, SF01).collect()
    check_packing(packed, [(i, r.text) for i, r in out["decontamination"].items()], 4096, 1)


def test_empty_documents(spark):
    docs = table(spark, SF01, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF01)
        assert docs.count() == 0
        if "text" in docs.columns:
            docs = cut(docs, "none")


def test_stages_with_null_ids_repeated_rows_and_clashing_names(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(80))
    rows = [(None, long, 1, "a", "x", 0.5, None), (1, long, 2, "a", "y", 0.1, 9), (1, long, 2, "a", "y", 0.1, 9), (2, "top\nof\npage\none", 3, None, "z", None, 1), (3, "top\nof\npage\ntwo", 4, "b", "z", None, 1), (4, None, 5, "b", "z", None, 1), (5, "", 6, "b", "z", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, removed string, sid string, score double, class_id long")
    table(spark, SF01, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, SF01, "labels").withColumn("doc_id", F.col("doc_id") + 1_000_000).write.parquet(f"{tmp_path}/labels.parquet")
    held, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = cut(stage(spark, held, str(tmp_path)), f"odd-{name}")
        assert held.columns == docs.columns
        kept[name] = sorted(((r.doc_id or 0, r.text, r.n_lines) for r in held.collect()), key=str)
    assert len(kept["toxicity"]) == len(rows)
    assert [r[:2] for r in kept["line_dedup"]] == [(0, long), (2, "top\nof\npage\none"), (3, "two"), (4, None), (5, "")]
    packed = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i or None for i, *_ in kept["decontamination"]}
