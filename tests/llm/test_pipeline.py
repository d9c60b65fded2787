import collections

import corpus_pipeline
from pyspark.sql import functions as F

from spanledger.llm import mixing, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "mixing to target weights", "packing"]
    good = corpus_pipeline.quality(spark, docs, SF).cache()
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.reports(docs).collect()}
    assert good.columns == names and {r["doc_id"] for r in good.select("doc_id").collect()} == {i for i, k in verdicts.items() if k}
    single = corpus_pipeline.near_copies(spark, good, SF).cache()
    texts = [r["text"] for r in single.collect()]
    assert single.columns == names and len(texts) == len(set(texts)) and 0 < len(texts) <= good.count()
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(t.lower().split()) for t in texts]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    cut = corpus_pipeline.repeats(spark, single, SF).cache()
    windows = collections.Counter(b[p : p + 200] for r in cut.collect() for b in (r["text"].encode(),) for p in range(len(b) - 199))
    assert cut.columns == names and cut.where(F.length("text") != F.col("n_chars")).count() == 0 and sum(n > 1 for n in windows.values()) < 0.01 * len(windows)
    mixed = corpus_pipeline.mix(spark, cut, SF).cache()
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.reports(cut).collect() if r["size"] and r["taken"]}
    assert mixed.columns == names and {i: n for i, n in copies.items() if i in want} == want
    packed = corpus_pipeline.pack(spark, mixed, SF).cache()
    assert packed.where("start = 0").count() == mixed.count() and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
