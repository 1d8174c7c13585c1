"""The pipeline against a plain recomputation of its stages."""

import os
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from textlens.llm import registry, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def base(spark, docs, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipe"))
    docs.write.parquet(f"{path}/documents.parquet")
    found = [(i, " ".join((r[1] or "").split()[60:75])) for i, r in enumerate(rows[:30])]
    spark.createDataFrame([(i, t) for i, t in found if t], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    marks = [(r[0], 1, int("w7" in (r[1] or "").split())) for r in rows]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, base):
    """Each stage on its own input, against the contracts."""
    docs = spark.read.parquet(f"{base}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, rows):
        df = spark.createDataFrame(rows, docs.schema)
        out = stages[name](spark, df, base)
        if name != "sharding":
            assert out.columns == docs.columns
        return [tuple(r) for r in out.collect()]

    rows = [tuple(r) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{base}/labels.parquet"))
    clean = [tuple(r)[:-1] for r in toxicity.score(docs, model, out="s").collect() if r["s"] < 0.5]
    got = step("toxicity", rows)
    assert Counter(got) == Counter(clean)

    root = brute.joined([brute.fingerprint(r[1]) for r in got], lambda a, b: (a ^ b).bit_count() <= 3)
    names = {c: w[2] for c, w in zip(root, brute.simhash(got), strict=True)}
    one = step("simhash_near_dedup", got)
    assert Counter(r[0] for r in one) == Counter(names.values())
    assert not Counter(one) - Counter(got)

    left = step("decontamination", one)
    assert Counter(left) == Counter(r for r, w in zip(one, brute.leaks(one, bench), strict=True) if not w[5])
    assert len(left) < len(one)

    mixed = step("mixing", left)
    want = Counter()
    for r, w in zip(left, brute.mixture(left), strict=True):
        want[r] += w[4] // w[1] if w[1] else 0
    assert Counter(mixed) == +want

    shards = step("sharding", mixed)
    assert Counter(r[:-2] for r in shards) == Counter(mixed)
    assert Counter((r[0], r[-2], r[-1]) for r in shards) == Counter((s[0], s[3], s[4]) for s in brute.shards(mixed))


def test_run(spark, base):
    out = corpus_pipeline.run(spark, base)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 0
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_stages_on_empty_tables(spark, base, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, base).count() == 0, name


def test_registry(spark):
    assert [k.split("_")[0] for k in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.ORACLE_SQL) < set(registry.QUERIES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, query in registry.QUERIES.items():
        got = query(spark, "/root/testdata/sf0.001")
        assert got.count() == docs.count(), name
        assert got.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty(), name
    toxic = registry.QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.001")
    assert toxic.where((F.col("score") >= 0.5).cast("int") != F.col("predicted")).isEmpty()
