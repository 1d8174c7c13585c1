"""What the byte dedup sends to its shards."""

import random

import numpy as np
import pyarrow as pa

from textlens.llm import byte_dedup
from textlens.llm.groups import deal


def test_stretches_hold_each_window_once():
    """Every window is in the stretch of the first of its grams of least hash."""
    rng = random.Random(5)
    texts = [bytes(rng.randrange(97, 100) for _ in range(n)) for n in (0, 49, 50, 51, 400, 1500)] + [b"ab" * 300, b"x" * 90]
    g = byte_dedup.Group(pa.table({"_bytes": pa.array(texts, pa.binary()), "_id": pa.array(range(len(texts)), pa.int64())}))
    held, name = {}, {}
    for p, h, a, b in zip(*(x.tolist() for x in byte_dedup.stretches(g, 50)), strict=True):
        name[p] = h
        for i in range(a, b - 49):
            assert held.setdefault(i, p) == p and i <= p <= i + 30
    windows = [i for a, b in zip(g.offsets[:-1].tolist(), g.offsets[1:].tolist(), strict=True) for i in range(a, b - 49)]
    assert sorted(held) == windows and sum(byte_dedup.stretches(g, 50)[3] - byte_dedup.stretches(g, 50)[2] - 49) == len(windows)
    raw = g.data.tobytes()
    by_bytes = {}
    for i in windows:  # equal windows have the same anchor at the same place
        assert by_bytes.setdefault(raw[i:i + 50], (held[i] - i, name[held[i]])) == (held[i] - i, name[held[i]])


def sent_bytes(spark, texts, hot_groups):
    """Bytes of the pieces that groups of 2,000 bytes send, all windows' bytes of
    crowded anchors together."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, n = deal(docs, "doc_id", "text", 2000)
    out = []
    for r in byte_dedup.sent_pieces(rows, n, 50, hot_groups).collect():
        at = 0
        for size in np.frombuffer(r["heads"], byte_dedup._PIECE)["size"].tolist():
            out.append(bytes(r["bytes"][at:at + size]))
            at += size
    return n, out


def test_crowded_anchors_send_only_windows_that_occur_elsewhere(spark):
    """A passage of many documents with other bytes around it: what is sent of
    crowded anchors is windows that two documents have, once for each group."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = word(120)
    texts = [word(90) + passage + word(90) for _ in range(200)]
    n, pieces = sent_bytes(spark, texts, 1)
    assert n > 20 and pieces and {len(p) for p in pieces} == {50}
    assert all(sum(p.decode() in t for t in texts) > 1 for p in pieces)
    inside = [p for p in pieces if p.decode() in passage]
    assert len(inside) <= n * (len(passage) - 49) and len(pieces) - len(inside) < 2 * len(texts) * 3


def test_copies_send_no_pieces(spark):
    """Texts of which every repeat is a whole copy have nothing to compare."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)) for _ in range(40)]
    assert sent_bytes(spark, texts * 3, 256)[1] == []
