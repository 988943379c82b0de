"""The pipeline against its stages done by hand on the smallest tables."""

from collections import Counter

import corpus_pipeline
from oddsloom.llm import common, mixing, quality, secret_scan
from oddsloom.llm.queries import WORD_BPE

from .test_operators import brute_near_texts, brute_spans


def test_run_equals_brute_force(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r in docs.collect() if float(model.score(quality.features(r.text)[None])[0]) >= 0.3]
    roots = brute_near_texts([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if roots[r.doc_id] == r.doc_id]
    clean = [(r.doc_id, secret_scan._cut(r.text, brute_spans(r.text), "[SECRET]"), r.lang, r.source, r.n_chars) for r in rows]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(clean, docs.schema)).collect()}
    lib = Tokenizer.from_file(WORD_BPE())
    want = Counter()
    for doc_id, text, *_ in clean:
        if copies[doc_id]:
            want[doc_id, tuple(lib.encode(text, add_special_tokens=False).ids)] += copies[doc_id]
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and len(want) > 100


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialize(stage(spark, now, sf), "stage")
        assert now.columns == docs.columns, name
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
