"""The stages one after another, each judged on its own input."""

from __future__ import annotations

import corpus_pipeline
from tidebars.llm import decontaminate, line_dedup, shingles, toxicity


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "'x' as ids", "1 as row")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    toxic, lines, near, clean, encode = (f for _, f in corpus_pipeline.STAGES)

    def ids(df):
        return {r["doc_id"] for r in df.select("doc_id").collect()}

    first = toxic(spark, docs, sf_dir).cache()
    scores = toxicity.weigh(docs, toxicity.learn(docs, labels))
    assert first.columns == docs.columns and ids(first) == ids(scores.where("score < 0.5"))
    second = lines(spark, first, sf_dir).cache()
    assert second.columns == docs.columns and ids(second) == ids(first)
    edited = line_dedup.dedup_lines(first, parts_of=line_dedup.chunkings_of)
    assert {tuple(r) for r in second.select("doc_id", "text").collect()} == {tuple(r) for r in edited.select("doc_id", "text").collect()}
    third = near(spark, second, sf_dir).cache()
    assert third.columns == docs.columns and ids(third) == ids(shingles.drop_similar(second))
    fourth = clean(spark, third, sf_dir).cache()
    assert fourth.columns == docs.columns and ids(fourth) == ids(decontaminate.contamination(third, items).where("n_hit = 0"))
    last = encode(spark, fourth, sf_dir)
    assert ids(last) == ids(fourth) and last.where("not round_trip").count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
