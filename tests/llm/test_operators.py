"""Every dealt operator against its plain recomputation, on odd rows."""

import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from textlens.llm import (byte_dedup, decontaminate, lines, mixing, quality, recompress, sharding, simhash,  # noqa: E402
                          substrings, tokens, toxicity)

ITEMS = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (2, "the"), (3, "The of THE"), (4, None), (5, ""), (6, "--"),
         (None, "über É"), (7, "edited"), (7, "x x x x x x x x x x x x x x")]


def same(df, want, cols):
    """The rows of ``df`` are ``want``, in any order."""
    got = [tuple(r) for r in df.select(*cols).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def items(spark, rows):
    found = [(10 + i, " ".join((r[1] or "").split()[5:25])) for i, r in enumerate(rows[:20])]
    return spark.createDataFrame(ITEMS + found, "item_id long, text string"), ITEMS + found


def test_sharding(docs, rows):
    got = sharding.assign_shards(docs)
    same(got, brute.shards(rows), ["doc_id", "size", "text_crc32", "shard", "slot"])
    whole = sharding.shard(docs)
    assert whole.columns == [*docs.columns, "shard", "slot"]
    same(whole.groupBy("shard").agg(F.count("*"), F.min("slot"), F.max("slot"), F.countDistinct("slot")),
         [(k, n := (k + 1) * len(rows) // 8 - k * len(rows) // 8, 0, n - 1, n) for k in range(8)],
         ["shard", "count(1)", "min(slot)", "max(slot)", "count(DISTINCT slot)"])
    same(whole, rows, docs.columns)
    same(whole.select("doc_id", F.col("shard")), [(r[0], r[3]) for r in brute.shards(rows)], ["doc_id", "shard"])


def test_sharding_follows_the_mixture(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"),
                                    F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = sharding.assign_shards(many).join(many, "doc_id").groupBy("shard", "source").count().toPandas()
    spread = got.groupby("source")["count"].agg(["min", "max"])
    assert ((spread["max"] - spread["min"]) <= 2).all()  # a cut may fall between rows of equal rank, at either end


@pytest.mark.parametrize("min_docs", [5, 2])
def test_lines(docs, rows, min_docs):
    out = lines.dedup_lines(docs, min_docs=min_docs)
    got = out.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    want = brute.lines(rows, min_docs=min_docs)
    assert sum(r[2] for r in want) > 5
    same(got, want, ["doc_id", "n_lines", "n_dropped", "sha"])
    same(out, [(r[0], *r[2:]) for r in rows], [c for c in docs.columns if c != "text"])


def test_lines_with_small_filter(docs, rows, monkeypatch):
    """A filter far too small only makes more suspects."""
    monkeypatch.setattr(lines, "MAX_BITS", 1 << 6)
    got = lines.dedup_lines(docs).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    same(got, brute.lines(rows), ["doc_id", "n_lines", "n_dropped", "sha"])


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, rows, block_bytes):
    bench, plain = items(spark, rows)
    got = decontaminate.contamination(docs, bench, block_bytes=block_bytes)
    want = brute.leaks(rows, plain)
    assert {r[5] for r in want} == {True, False} and max(r[3] for r in want) > 1
    same(got, want, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def test_clean(spark, docs, rows):
    bench, plain = items(spark, rows)
    left = [r for r, w in zip(rows, brute.leaks(rows, plain), strict=True) if not w[5]]
    same(decontaminate.clean(docs, bench), left, docs.columns)


def test_decontamination_without_items(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    same(decontaminate.contamination(docs, none).agg(F.count("*"), F.sum("n_hit")), [(len(rows), 0)], ["*"])


def test_simhash(docs, rows):
    got = simhash.near_duplicates(docs).withColumn("hex", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    want = brute.simhash(rows)
    same(got, want, ["doc_id", "hex", "component_id"])


def test_keep_one(docs, rows):
    want = brute.simhash(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    root = brute.joined([brute.fingerprint(r[1]) for r in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    names = {c: w[2] for c, w in zip(root, want, strict=True)}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(names.values())


@pytest.mark.parametrize("group_bytes", [1 << 22, 2000])
def test_substrings(docs, rows, group_bytes):
    out = substrings.dedup_substrings(docs, group_bytes=group_bytes)
    got = out.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    want = brute.substrings(rows)
    assert sum(r[2] for r in want) > 500
    same(got, want, ["doc_id", "n_words", "n_removed", "sha"])
    same(out, [(r[0], *r[2:]) for r in rows], [c for c in docs.columns if c != "text"])


@pytest.mark.parametrize("window", [1, 2, 5, 13, 20])
def test_substrings_of_other_windows(docs, rows, window):
    got = substrings.dedup_substrings(docs, window, group_bytes=5000).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    same(got, brute.substrings(rows, window), ["doc_id", "n_words", "n_removed", "sha"])


def test_equal_digests_are_no_proof():
    """Pieces that share key and digest are told apart by their bytes."""
    rng = random.Random(3)
    one, two = (bytes(rng.randrange(97, 123) for _ in range(80)) for _ in range(2))
    texts = [(1, one, 5), (2, two, 6), (3, one, 7), (4, two, 8), (5, two[:60], 9), (6, one[:20] + two[20:], 10)]
    heads = np.zeros(len(texts), byte_dedup._PIECE)
    heads["key"], heads["hash"], heads["places"] = 1, 99, 1
    heads["doc"], heads["size"] = [t[0] for t in texts], [len(t[1]) for t in texts]
    table = pa.table({"bucket": pa.array([0], pa.int32()), "db": pa.array([4], pa.int32()), "heads": [heads.tobytes()],
                      "bytes": [b"".join(t[1] for t in texts)], "places": [np.array([t[2] for t in texts], "<u4").tobytes()],
                      "known": [b""]})
    got = {}
    for r in byte_dedup._shard(table, 50).to_pylist():
        assert r["_db"] == 4
        for at, n in np.frombuffer(r["spans"], byte_dedup._SPAN).tolist():
            got[at] = n
    assert got == {7: 31, 8: 31, 9: 11, 10 + 20: 11}
    data = np.frombuffer(b"".join(t[1] for t in texts), np.uint8)
    size = heads["size"].astype(np.int64)
    begin = np.cumsum(size) - size
    for block in (1, 70, 1 << 20):
        assert sorted(byte_dedup._other_bytes(data, begin, size, np.zeros(6, np.int64), block).tolist()) == [1, 3, 4, 5]


@pytest.mark.parametrize("group_bytes, hot_groups", [(1 << 22, 256), (2000, 256), (2000, 1), (2000, 3)])
def test_byte_dedup(docs, rows, group_bytes, hot_groups):
    """In one group and in many, with none, some and all anchors crowded."""
    out = byte_dedup.dedup_bytes(docs, group_bytes=group_bytes, hot_groups=hot_groups)
    want = brute.byte_runs(rows)
    assert sum(r[2] for r in want) > 2000
    same(out.withColumn("sha", F.sha2("text", 256)), want, ["doc_id", "n_bytes", "n_removed", "n_spans", "sha"])
    same(out, [(r[0], *r[2:]) for r in rows], [c for c in docs.columns if c != "text"])


def test_decontamination_of_a_window_that_all_items_share(spark, monkeypatch):
    """The driver sees each window once, however many items share it."""
    shared = "a b c d e f g h i j"
    bench = spark.createDataFrame([(i, f"{shared} x{i}" if i % 100 == 0 else shared) for i in range(2000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {shared} it is"), (2, f"{shared} x500"), (3, "b c"), (4, f"so {shared} it is")],
                                 "doc_id long, text string")
    seen, start = [], decontaminate.Block.__init__
    monkeypatch.setattr(decontaminate.Block, "__init__", lambda self, rows, *a: seen.append(len(rows)) or start(self, rows, *a))
    got = decontaminate.contamination(docs, bench)
    every = hashlib.sha256(",".join(sorted(str(i) for i in range(2000))).encode()).hexdigest()
    same(got, [(1, 13, 10, 2000, every, True), (2, 11, 11, 2000, every, True),
               (3, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False), (4, 13, 10, 2000, every, True)],
         ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    assert seen == [1 + 20]


def test_item_windows_of_a_long_item(spark):
    """Blanks behind the last cut of a long item make no window of their own."""
    words = [f"w{i}" for i in range(20)]
    got = decontaminate.item_windows(spark.createDataFrame([(1, " ".join(words) + " " * (3 << 19))], "item_id long, text string"))
    same(got, [("1", " ".join(words[i: i + 10]).encode()) for i in range(11)], ["item", "words"])


def test_token_counts(docs, rows):
    sp = tokens.load(tokens.MODEL)
    want = [(r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in rows]
    for part, call in ((1 << 15, 1 << 20), (7, 50)):
        same(tokens.count_tokens(docs, part=part, call=call), want, ["doc_id", "n_bytes", "n_tokens"])


def test_token_parts():
    text = "  one two  three\nfour ▁ five ▁six seven\teight " * 20 + "x" * 500
    sp = tokens.load(tokens.MODEL)
    for most in (1, 2, 5, 17, 100):
        got = list(tokens.parts(text, most))
        assert len(got) > 5
        assert [i for p in got for i in sp.encode(p)] == sp.encode(text)


def test_mixing(docs, rows):
    want = brute.mixture(rows)
    same(mixing.taken(docs), want, ["doc_id", "size", "source_size", "target", "taken"])
    n = sum(r[4] // r[1] for r in want if r[1])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == n
    assert all(r[4] <= 3 * r[1] for r in want)


def test_mixing_meets_its_targets(spark):
    many = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = mixing.taken(many).join(many, "doc_id").groupBy("source").agg(
        F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("m"))
    for r in got.collect():
        assert abs(r["t"] - r["g"]) <= 3 * 8 and r["m"] <= 3


@pytest.mark.parametrize("min_group", [50, 8, 3])
def test_quality(docs, rows, min_group):
    got = quality.judge(quality.measures(docs), min_group=min_group)
    same(got, brute.quality(rows, min_group), ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                               "base_failed", "kept"])
    assert got.where("kept and base_failed").isEmpty() and not got.where("kept").isEmpty()


@pytest.mark.parametrize("n_fr", [0, 7, 60])
def test_quality_verdicts_and_twin(spark, tmp_path, n_fr):
    """A spammy source, a rare language and all documents together: the
    operator, the plain rule and the SQL agree on every verdict."""
    import duckdb
    good, bad = "word " * 3 + " ".join(f"t{i}x" for i in range(100)), " ".join(f"t{i}x###" for i in range(100))
    odd = [good + f" {i}" + " y" * (i % 9) + (" long" * 0 if i % 7 else " " + "z" * (i * 5)) for i in range(400)]
    rows = [(i, t, "en", "s") for i, t in enumerate(odd)]
    rows += [(1000 + i, (bad if i % 2 else good) + f" {i}", "en", "hot") for i in range(100)]
    rows += [(2000 + i, (bad if i % 3 == 0 else good) + f" {i}", "fr", None) for i in range(n_fr)]
    rows += [(3000, bad, None, None), (3001, good, None, "s"), (3002, None, "de", "s")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    got = {r["doc_id"]: r["kept"] for r in quality.op10_quality_rules(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[-1] for r in brute.quality(rows)}
    assert not got[1001] and not got[3000] and got[3001]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == {r[0]: r[-1] for r in con.execute(quality.OP10_SQL).fetchall()}


def test_quality_fences(spark):
    """Fences follow each language and source; groups without any sketch pass."""
    good, bad = "word " * 3 + " ".join(f"t{i}x" for i in range(100)), " ".join(f"t{i}x###" for i in range(100))
    rows = [(i, good + f" {i}", "en", "s") for i in range(99)] + [(99, bad, "en", "s")]
    rows += [(200 + i, bad + f" {i}", "fr", "t") for i in range(60)] + [(300, bad, None, None)]
    got = quality.judge(quality.measures(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert {r["doc_id"] for r in got.where("not kept").collect()} == {99}


def test_quality_fences_hold_in_a_spammy_source(spark):
    """Half of a source is junk: the fences of its language reject it."""
    good, bad = "word " * 3 + " ".join(f"t{i}x" for i in range(100)), " ".join(f"t{i}x###" for i in range(100))
    rows = [(i, good + f" {i}", "en", "s") for i in range(400)]
    rows += [(1000 + i, (bad if i % 2 else good) + f" {i}", "en", "hot") for i in range(100)]
    got = quality.judge(quality.measures(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert {r["doc_id"] for r in got.where("not kept").collect()} == set(range(1001, 1100, 2))


def test_toxicity_accuracy(spark):
    base = "/root/testdata/sf0.1"
    from textlens.llm.common import read
    docs, marks = read(spark, base, "documents").select("doc_id", "text", "lang"), read(spark, base, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, marks, max_rows=2500)).withColumn("held", toxicity.held_out(F.col("doc_id")))
    r = scored.join(marks, "doc_id").where("held").toPandas()
    hit = (r.score >= 0.5) == (r.toxic == 1)
    assert hit.mean() > 0.97
    assert (r.score[r.toxic == 1] >= 0.5).mean() > 0.8
    assert (r.score[r.toxic == 0] >= 0.5).mean() < 0.02
    assert r.score.between(0, 1).all()


def small_net(seed=5):
    """A network in double precision and a batch of three texts, one empty."""
    rng = np.random.default_rng(seed)
    m = toxicity.Model(tables=[rng.standard_normal((toxicity.BUCKETS, toxicity.DIM)) * 0.5 for _ in range(2)],
                       filters=[[rng.standard_normal((k, toxicity.DIM, toxicity.FILTERS)) * 0.5, rng.standard_normal(toxicity.FILTERS) * 0.1]
                                for k in toxicity.WIDTHS],
                       layers=[[rng.standard_normal((2 * toxicity.FILTERS * 3 + 1, toxicity.HIDDEN)) * 0.3, rng.standard_normal(toxicity.HIDDEN) * 0.1],
                               [rng.standard_normal(toxicity.HIDDEN), np.array([0.2])]])
    ids = rng.integers(0, 6, (13, 2)).astype(np.uint16)
    return m, ids, np.array([0, 8, 8, 13])


def plain_logit(m, words):
    """The network word by word, filter by filter."""
    x = [m.tables[0][a] + m.tables[1][b] for a, b in words.tolist()]
    most, total = [], []
    for k, (w, b) in zip(toxicity.WIDTHS, m.filters, strict=True):
        outs = [np.zeros(toxicity.FILTERS)]
        for i in range(len(x)):
            z = b + sum(x[i + j] @ w[j] for j in range(k) if i + j < len(x))
            outs.append(np.maximum(z, 0))
        most += np.max(outs, 0).tolist()
        total += np.sum(outs, 0).tolist()
    h = np.array([*most, *np.log1p(total), np.log1p(len(words)) / 8])
    return float(np.tanh(h @ m.layers[0][0] + m.layers[0][1]) @ m.layers[1][0] + m.layers[1][1][0])


def test_toxicity_forward_pass():
    m, ids, first = small_net()
    got = toxicity._forward(m, ids, first)[0]
    want = [plain_logit(m, ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == pytest.approx(want, abs=1e-5)


def test_toxicity_gradient():
    """Against differences of the loss, for every kind of weight."""
    m, ids, first = small_net()
    y = np.array([1.0, 0.0, 0.0])
    known = [np.ones(toxicity.BUCKETS, bool), np.arange(toxicity.BUCKETS) != 3]

    def loss():
        z = np.array([plain_logit(m, ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)])
        return float(np.sum(np.logaddexp(0, z) - y * z))
    f = lambda p: p.astype(np.float32)
    single = toxicity.Model(tables=[f(t) for t in m.tables], filters=[[f(w), f(b)] for w, b in m.filters],
                            layers=[[f(w), f(b)] for w, b in m.layers])
    z, kept = toxicity._forward(single, ids, first)
    grads = toxicity._backward(single, kept, (1 / (1 + np.exp(-z)) - y).astype(np.float32), known)
    params = [*m.tables, *[p for f in m.filters for p in f], *[p for la in m.layers for p in la]]
    assert not (grads[1][0] == 3).any()  # a hash that is not known stays
    rng = np.random.default_rng(0)
    for p, g in zip(params, grads, strict=True):
        dense = np.zeros(p.shape)
        if isinstance(g, tuple):
            dense[g[0]] = g[1]
            places = [(int(r), int(rng.integers(toxicity.DIM))) for r in g[0]]
        else:
            dense += np.asarray(g).reshape(p.shape)
            places = [tuple(int(rng.integers(n)) for n in p.shape) for _ in range(6)]
        for at in places:
            held, eps = p[at], 1e-5
            p[at] = held + eps
            up = loss()
            p[at] = held - eps
            down = loss()
            p[at] = held
            assert dense[at] == pytest.approx((up - down) / (2 * eps), abs=1e-3)


def test_toxicity_has_a_threshold_for_every_language():
    """Thirty languages of 40 texts and five of 2: the thirty are told apart,
    the five and unknown texts are "other"."""
    rng = np.random.default_rng(2)
    docs = []
    for lang in range(35):
        for i in range(40 if lang < 30 else 2):
            words = rng.integers(lang * 300, lang * 300 + 60, 25)
            docs.append((np.stack([words, words], 1).astype(np.uint16), i % 2, f"l{lang:02d}"))
    m = toxicity.train(docs)
    assert m.langs.shape[1] == 31 and len(m.shift) == 31
    def guess(words):
        ids = np.stack([words, words], 1).astype(np.uint16)
        return int(np.argmax(toxicity._lang_sums(m, ids, np.array([0, len(ids)]))))
    assert [guess(np.arange(k * 300, k * 300 + 20)) for k in range(13)] == list(range(13))  # buckets are shared beyond 4,096
    assert guess(np.arange(3970, 3990)) == 30 == guess(np.arange(808, 828))  # unknown words, a rare language
    old, toxicity.LANG_BLOCK = toxicity.LANG_BLOCK, 31 * 7
    try:
        first = np.array([0, 0, 9, 9, 20])
        ids = np.stack([np.arange(20)] * 2, 1).astype(np.uint16)
        blocks = toxicity._lang_sums(m, ids, first)
    finally:
        toxicity.LANG_BLOCK = old
    assert np.allclose(blocks, toxicity._lang_sums(m, ids, first)) and not blocks[0].any()


def test_toxicity_odd_rows(spark, docs, rows):
    marks = spark.createDataFrame([(r[0], None, int(i % 3 == 0)) for i, r in enumerate(rows)] + [(None, 1, 1), (3, 1, None)],
                                  "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    out = toxicity.score(docs, model)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({round(r["score"], 5) for r in got if not brute.ALNUM_WORD.search((r["text"] or "").lower())}) == 1
    again = {(r["doc_id"], r["text"]): r["score"] for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    assert all(abs(again[r["doc_id"], r["text"]] - r["score"]) < 1e-5 for r in got)
    # neither language nor source nor id takes part in a score
    other = toxicity.score(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None), "doc_id": F.lit(1)}), model).collect()
    assert sorted(r["score"] for r in other) == pytest.approx(sorted(r["score"] for r in got))


@pytest.mark.parametrize("label", [0, 1, None])
def test_toxicity_without_both_labels(spark, docs, label):
    marks = spark.createDataFrame([(1, 1, label), (2, 1, label)], "doc_id long, quality int, toxic int")
    scores = {round(r["score"], 6) for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    assert scores == {{0: 0.0, 1: 1.0, None: 0.0}[label]}


def test_toxicity_never_learns_the_held_out_fold(spark, docs, rows):
    ids = [r[0] for r in rows]
    held = {r["doc_id"] for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    marks = spark.createDataFrame([(i, int(i in held)) for i in ids if i is not None], "doc_id long, toxic int")
    assert not toxicity.fit(docs, marks).tables  # label 1 only in the held-out fold: nothing to learn


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (sharding.assign_shards(empty), sharding.shard(empty), lines.dedup_lines(empty),
                decontaminate.contamination(empty, bench), decontaminate.clean(empty, bench),
                simhash.near_duplicates(empty), simhash.keep_one(empty), substrings.dedup_substrings(empty),
                tokens.count_tokens(empty), mixing.taken(empty), mixing.mix(empty), byte_dedup.dedup_bytes(empty),
                toxicity.score(empty, toxicity.fit(empty, marks)), quality.judge(quality.measures(empty))):
        assert out.count() == 0


def test_plan_of_partitions_is_complete():
    """Thresholds + 1 always sum to distance + 1, whatever the estimates."""
    rng = np.random.default_rng(0)
    for n in (1, 50, 10**5, 10**8, 10**11):
        for distance in (0, 1, 3, 5):
            x = np.concatenate([rng.choice([-1, 1], (500, 64)), np.ones((500, 1))], 1)
            x[:, 5] = x[:, 6]
            sums = ((x.T @ x) * (n / 500)).astype(np.int64)
            chosen = simhash.plan(n, sums, distance)
            assert sum(t + 1 for _, t in chosen) == distance + 1
            assert len({b for bits, _ in chosen for b in bits}) == sum(len(bits) for bits, _ in chosen)


@pytest.mark.parametrize("verify", [1e-9, 0.01, 1e6])
def test_links_whatever_the_plan(spark, monkeypatch, verify):
    """Crowds and chains of fingerprints are joined by few or many partitions."""
    monkeypatch.setattr(simhash, "VERIFY", verify)
    monkeypatch.setattr(simhash.plan, "__defaults__", (3, verify))
    rng = np.random.default_rng(1)
    x = [int(v) for v in rng.integers(0, 2**63, 40)]
    for c in x[:4]:  # a crowd around a centre, and a chain
        x += [c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in range(120)]
        for _ in range(20):
            c ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            x.append(c)
    x = sorted(set(x))
    want = brute.joined(x, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = [v - 2**64 if v >= 2**63 else v for v in x]
    from textlens.llm.components import components
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(
        spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    groups = {}
    for v, w in zip(signed, want, strict=True):
        assert groups.setdefault(w, roots.get(v, v)) == roots.get(v, v)
    assert len(set(groups.values())) == len(groups)


def test_forest_of_a_crowd(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = np.random.default_rng(2)
    x = np.unique(np.concatenate([rng.integers(0, 2**63, 300).astype(np.uint64),
                                  np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))]))
    links = [(int(a), int(b)) for u, v in simhash._forest(x, 3) for a, b in zip(u, v, strict=True)]
    assert all((a ^ b).bit_count() <= 64 for a, b in links) and len(links) < 6 * len(x)
    want = brute.joined([int(v) for v in x], lambda a, b: (a ^ b).bit_count() <= 3)
    parent = {int(v): int(v) for v in x}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in links:
        parent[find(a)] = find(b)
    got = [find(int(v)) for v in x]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(x)) for j in range(0, i, 7))


def test_whole_long_texts(spark, docs, rows, monkeypatch):
    """Texts of many pieces (of a few hundred bytes here) give the same results."""
    from textlens.llm import words
    bench, plain = items(spark, rows)

    def small(f):
        def run(*a, **k):
            for module in (words, byte_dedup):
                monkeypatch.setattr(module, "CHUNK", 300)
            for g, n in ((words.batch_words, -2), (words.chunks, -1), (words.split_pieces, -1)):
                d = list(g.__defaults__)
                d[n] = 300
                g.__defaults__ = tuple(d)
            return f(*a, **k)
        return run

    # the functions run in Python workers: the small size has to be set there
    monkeypatch.setattr(substrings, "_shared_names", small(substrings._shared_names))
    table = pa.table({"_bytes": pa.array([(r[1] or "").encode() for r in rows]), "_id": pa.array([r[0] for r in rows], pa.int64())})
    defaults = [(g, g.__defaults__) for g in (words.batch_words, words.chunks, words.split_pieces)]
    try:
        whole, _ = substrings._shared_names(table, recompress.schedule(35))
        for r in rows:
            assert simhash.fingerprint((r[1] or "").encode()) == brute.fingerprint(r[1])
        g = byte_dedup.Group(table)
        places, hashes = byte_dedup.anchors(g, 50)
        seen = {}
        for p, h in zip(places.tolist(), hashes.tolist(), strict=True):
            assert seen.setdefault(p, h) == h
        assert len(seen) == len(places)
    finally:
        for f, d in defaults:
            f.__defaults__ = d
    monkeypatch.undo()
    plain_names, _ = substrings._shared_names(table, recompress.schedule(35))
    assert np.array_equal(whole, plain_names)
    once, at = byte_dedup.anchors(byte_dedup.Group(table), 50)
    assert set(once.tolist()) == set(places.tolist())
    model = toxicity.train([(np.array([[i, i]], np.uint16).repeat(5, 0), i % 2, "en") for i in range(40)])
    texts = pa.array([r[1] for r in rows])
    want = toxicity.text_scores(model, texts)
    words.batch_words.__defaults__ = (300, 0)  # the overlap is given
    try:
        got = toxicity.text_scores(model, texts)
    finally:
        words.batch_words.__defaults__ = defaults[0][1]
    assert np.allclose(got, want, atol=1e-5)
