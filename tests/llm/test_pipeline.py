import numpy as np

import corpus_pipeline
from palimpsest.llm import decontamination, mixing, near_duplicates, packing, toxicity


def test_stages_keep_columns_and_decide(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "packing"]
    before = docs
    seen = {}
    for name in list(stages)[:-1]:
        stages[name](spark, before, src).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == docs.columns
        seen[name] = (sorted(r.doc_id for r in before.collect()), sorted(r.doc_id for r in after.collect()))
        before = after
    labels = spark.read.parquet(f"{src}/labels.parquet").where(corpus_pipeline.crc_mod(corpus_pipeline.F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs, labels.select("doc_id", "toxic"))
    ids = seen["toxicity"][0]
    score, _ = model.score([texts[i] for i in ids])
    assert seen["toxicity"][1] == [i for i, p in zip(ids, score, strict=True) if p < 0.5]
    # near-duplicates by brute force over sets
    start, kept = seen["near_dedup"]
    sets = {i: set(near_duplicates.shingle_set(texts[i], 5).tolist()) for i in start}
    root = {i: i for i in start}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in start:
        for b in start:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert kept == [i for i in start if find(i) == i]
    start, kept = seen["decontamination"]
    gone = {r.doc_id for r in decontamination.matches(docs, spark.read.parquet(f"{src}/benchmark.parquet")).collect()}
    assert kept == [i for i in start if i not in gone] and set(start) & gone
    start, kept = seen["mixing"]
    assert set(kept) <= set(start) and max(map(kept.count, kept)) <= mixing.EPOCHS
    rows = stages["packing"](spark, before, src).collect()
    assert sum(s.length for r in rows for s in r.segments) == sum(r.n_tokens for r in rows) > 0
    assert all(len(np.frombuffer(r.ids, np.uint16)) == packing.CAPACITY for r in rows)


def test_columns_of_any_name_come_through(spark, docs_of, tmp_path):
    docs = docs_of([(1, "Some harmless words in a row, said calmly."), (2, None)])
    for name in ("score", "repeats", "n_tokens", "predicted", "_s", "domain"):
        docs = docs.withColumn(name, docs.doc_id * 7)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert all(r.score == r.doc_id * 7 for r in out.collect())
