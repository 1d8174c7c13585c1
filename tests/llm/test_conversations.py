"""The operators on conversations against their plain recomputations."""

import itertools
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from test_operators import same  # noqa: E402

from textlens.llm import prefix_trie, repair  # noqa: E402
from textlens.llm.ordered import numbered  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, owner string, code string, _at string"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(seed=5):
    """Shared prefixes, copies, gaps, nulls, repeated rows and turns, blanks,
    strange roles, ids below zero and far apart, one long conversation."""
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage", "Uwe"]
    texts = ["Yes.", "No!", "And then", " ", "", None, "Über alles?\t", "a\x00b.", "x" * 3000 + ".", "Yes. \n", ":", "\n:"]
    rows = []
    for c in [*range(-3, 40), *range(99, 112), 1000, 1001, 2**40, -250, -205]:
        n = rng.choice([0, 1, 2, 3, 4, 6, 8])
        for t in range(n):
            turn = rng.choice([t, t, t, 2 * t, None, 3])
            plain = rng.random() < 0.7
            rows.append((c, turn, ["user", "assistant"][t % 2] if plain else rng.choice(roles),
                         f"Text {t % 3} of {c % 4}." if plain else rng.choice(texts)))
    for c in range(500, 530):  # copies, and copies that go on
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Copy {t}.") for t in range(4 + (c % 7 == 0))]
    rows += [(700, t, rng.choice(roles[:5]), rng.choice(texts)) for t in range(700)]
    rows += [(701, t, "user", f"t{t}.") for t in range(300)] + [(702, t, "user", f"t{t}.") for t in range(280)]
    rows += [(None, 1, "user", "Lost."), (None, None, None, None), (7, 1, "user", "Yes."), (7, 1, "user", "Yes."), (8, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return conversations()


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conv"))
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("n", [1, 3, 40])
def test_numbered(spark, n):
    """Places and prefix hashes do not depend on where the ranges are cut."""
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 1, 1, 2, -5]), i, rng.getrandbits(63)) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = numbered(spark.createDataFrame(rows, "k long, i long, s long"), "k", [prefix_trie.F.col("i")], ["s"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = []
    for k in {r[0] for r in rows}:
        h = 0
        for at, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1])):
            h = (h + r[2] * pow(0x9E3779B97F4A7C15, at, 1 << 64)) % (1 << 64)
            want.append((*r, at, h - (1 << 64) if h >> 63 else h))
    key = lambda r: (r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_trie_of_rebuilt_conversations(spark, rows, table):
    want = brute.trie(brute.rebuilt(rows))
    assert max(r[1] for r in want) > 250 and max(r[3] for r in want if r[1] > 2) > 10
    same(prefix_trie.op11_conversation_trie(spark, table), want, TRIE)


@pytest.mark.parametrize("shard_convs, held, band", [(1, 3, 5), (5, 1, 1), (20, 1 << 20, 1 << 20)])
def test_trie_with_small_shards(spark, rows, table, monkeypatch, shard_convs, held, band):
    """Many shards, bands and spilled runs give the same totals."""
    bands = prefix_trie._bands
    monkeypatch.setattr(prefix_trie, "_bands", lambda above, _: bands(above, band))
    forward = prefix_trie.time_forward

    def small(batches):
        prefix_trie.HELD = held
        return forward(batches)
    monkeypatch.setattr(prefix_trie, "time_forward", small)
    convs = {c: [(r, t) for _, r, t in v] for c, v in brute._in_order(rows, "").items() if c is not None}
    got = prefix_trie.prefix_trie(spark.read.parquet(f"{table}/conversations.parquet"), shard_convs)
    same(got, brute.trie(convs), TRIE)


def test_queue_spills():
    q, rng = prefix_trie.MessageQueue(held=10), np.random.default_rng(1)
    a, x = rng.integers(0, 50, 200), rng.integers(0, 9, 200)
    for i in range(0, 200, 20):
        q.push(a[i:i + 20], x[i:i + 20], 2 * x[i:i + 20])
    assert q.spilled > 3
    q.next_level()
    got = np.concatenate([q.pop(to) for to in (3, 3, 20, 49)], axis=1)
    want = np.bincount(a, weights=x, minlength=50).astype(int)
    there = np.unique(a)
    assert got[0].tolist() == there.tolist() and got[1].tolist() == want[there].tolist() and (got[2] == 2 * got[1]).all()
    q.next_level()
    q.push(np.array([1]), np.array([1]), np.array([1]))
    q.next_level()
    with pytest.raises(ValueError):
        q.next_level()


def test_trie_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(empty).count() == 0
    found, rows = repair.repair(empty)
    assert found.count() == 0 and rows.count() == 0


def test_repair_of_damaged_conversations(spark, rows, table):
    want = brute.repairs(rows)
    assert {c for r in want for c in r[7]} == set("DIKR")
    same(repair.op12_structure_repair(spark, table), want, REPAIR)


def test_repaired_rows(spark, rows, table):
    """The rows themselves, without damage."""
    plans, out = repair.repair(spark.read.parquet(f"{table}/conversations.parquet"))
    want = {c: brute.cheapest_repair(v) for c, v in brute._in_order(rows, " ").items()}
    same(plans, [(c, w[0], w[1]) for c, w in want.items()], ["conv_id", "cost", "audit"])
    same(out, [(c, i, *x) for c, w in want.items() for i, x in enumerate(w[2])], ["conv_id", "place", "role", "text"])


def test_every_short_signature():
    """All signatures of up to three rows against all edits."""
    text = {0: "Fine.", 1: "cut", 2: " "}
    for n in range(4):
        for signature in itertools.product(range(12), repeat=n):
            turns = [(i, "sua?"[s % 4] + str(i), text[s // 4]) for i, s in enumerate(signature)]
            path = [repair.END]
            for s in reversed(signature):
                path.append(repair.before(s, path[-1]))
            cost, audit, kept, _ = brute.cheapest_repair(turns)
            assert (path[-1][0][0], repair._audit(bytes(signature), path)) == (cost, audit), signature
            got = [(new or turns[i][1], "" if i is None else turns[i][2]) for edit, i, new in repair.steps(audit, signature) if edit != "D"]
            assert got == kept


def test_nodes_are_computed_once(spark):
    """The word graph has a node for each distinct suffix of all signatures."""
    import pyarrow as pa
    rng = random.Random(4)
    words = sorted({bytes(rng.choices([1, 2, 5, 8], k=rng.randrange(9))) for _ in range(400)})
    got = list(repair.cheapest(iter([pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], ["reversed"])])))
    assert sum(got[0].column("nodes").to_pylist()) == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_other_ids_are_an_error(spark):
    bad = spark.createDataFrame([("a", 1, "user", "x")], "conv_id string, turn long, role string, text string")
    for f in (prefix_trie.prefix_trie, repair.repair):
        with pytest.raises(ValueError):
            f(bad)
