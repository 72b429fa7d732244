from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from palimpsest.llm import toxicity
from palimpsest.llm.token_files import default_tokenizer
from palimpsest.llm.trie_bpe import trie_encoder

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    model = toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.toxicity for r in toxicity.without_text(docs, model).collect()}
    assert kept.columns == columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, s in scores.items() if s < toxicity.LIMIT)
    single = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert single.columns == columns and single.select("text").distinct().count() == single.count()
    masked = corpus_pipeline.mask_personal_data(spark, docs, SF)
    assert masked.columns == columns and masked.count() == docs.count() and masked.filter(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.")).count() == 0
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == columns
    last = corpus_pipeline.encode(spark, docs, SF).collect()
    own = trie_encoder(default_tokenizer())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(own.encode([texts[r.doc_id].encode()])[0]) for r in last)


def test_run(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "pii", "source_mix", "trie_bpe"]
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_entry_without_this_part(monkeypatch):
    import sys

    import __spark_entry__ as entry

    with_all = set(entry.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert with_all - set(entry.queries()) == {"pipeline"}
    import palimpsest

    monkeypatch.delattr(palimpsest, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "palimpsest.llm", None)
    assert all(not q.startswith("op") for q in entry.queries())
