"""The pipeline's stages one by one against brute force."""

from collections import Counter

import corpus_pipeline
from loomtext.llm import mixing

from . import fixtures as X


def test_stages(spark, tmp_path):
    rows = X.awkward(seed=6)
    extra = " ".join(rows[4][1].split()[:20])
    items = [(1, extra), (2, "never seen anywhere at all")]
    spark.createDataFrame(rows, X.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out/{k}")
        docs = spark.read.parquet(f"{tmp_path}/out/{k}")
        out = [tuple(r) for r in docs.select(*columns).collect()]
        if name == "quality rules":
            assert not Counter(out) - Counter(seen)
            assert all(not X.base_rules(r[1])[-1] for r in out) and len(out) > 20
        elif name == "near-dedup":
            want = X.near_duplicates(seen)
            assert sorted(r[0] for r in out if r[0] is not None) == sorted({c for _, c in want.values()})
        elif name == "decontamination":
            dirty = {i for i, _ in X.leaks(seen, items) if i is not None}
            assert Counter(out) == Counter(r for r in seen if r[0] not in dirty) and (dirty or extra not in " ".join(r[1] for r in seen))
        elif name == "mixing":
            size = Counter()
            for r in seen:
                size[r[3]] += len(X.words(r[1]))
            order = sorted(size, key=lambda s: (s is None, s or ""))
            goal = mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2)
            got = Counter()
            for r in out:
                got[r[3]] += len(X.words(r[1]))
            assert all(abs(got[s] - g) <= 0.02 * g + 200 for s, g in zip(order, goal, strict=True))
            assert {r[0] for r in out} <= {r[0] for r in seen}
        else:
            assert Counter(out) == Counter(seen)
        if name != "sharding":
            assert docs.columns == columns
        seen = out
    placed = docs.collect()
    for s in range(8):
        own = sorted(r.slot for r in placed if r.shard == s)
        assert own == list(range(len(own)))


def test_run_gives_the_stages_rows(spark, tmp_path):
    rows = X.awkward(seed=7, n=25)
    spark.createDataFrame(rows, X.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b = (sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) for _ in range(2))
    assert a and a == b
