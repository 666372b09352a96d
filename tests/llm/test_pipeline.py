"""The pipeline, stage by stage, against brute force on each stage's own input."""

from collections import Counter

import corpus_pipeline
from barloom.llm import mixing, packing, toxicity

from . import brute
from .test_operators import check_packing, lines_by_hand


def test_stages(spark, data, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    columns, results = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        results.append((before, docs))
        assert k == 4 or docs.columns == columns
    rows = lambda df: [r.asDict() for r in df.collect()]

    before, after = map(rows, results[0])
    machine = toxicity.train(results[0][0], labels)
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if machine.score(r["text"]) < 0.5)

    before, after = map(rows, results[1])
    want = {r["doc_id"]: t for r, t in zip(before, lines_by_hand([(r["source"], r["text"]) for r in before], 0.1, 3, True), strict=True)}
    assert {r["doc_id"]: r["text"] for r in after} == want and len(after) == len(before)
    assert any(r["text"] != want[r["doc_id"]] for r in before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = map(rows, results[2])
    comp = brute.components([r["doc_id"] for r in before], [brute.fingerprint(r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(comp)) and len(after) < len(before)

    before, after = map(rows, results[3])
    taken = {r["doc_id"]: r["taken"] for r in mixing.Mix(results[3][0]).taken().collect()}
    got = Counter()
    for r in after:
        got[r["doc_id"]] += len(brute.WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == Counter({k: v for k, v in taken.items() if v})

    before, after = map(rows, results[4])
    n = check_packing(after)
    assert sum(r["piece"] == 0 for r in after) == len(before)
    assert n <= 1.02 * -(-sum(r["length"] for r in after) // packing.LENGTH) + 1


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_awkward_rows(spark, data):
    for _, stage in corpus_pipeline.STAGES:
        for docs in (brute.awkward(spark), brute.empty(spark)):
            stage(spark, docs, data).count()
