"""SimHash near-duplicates by the general pigeonhole principle.

1. A text's 64-bit fingerprint has the majority of each bit over the XXH64
   values of its word shingles. Equal fingerprints are one node.
2. From the second moments of all nodes' bits (one 65 x 65 sum) strongly
   correlated bits are put into the same partition, for 1 to ``distance`` + 1
   partitions.
3. Dynamic programming gives partition i the threshold t_i (-1: not used)
   with sum(t_i + 1) = distance + 1 and the least estimated work; two
   fingerprints within ``distance`` then agree to within t_i bits in some
   partition i. The cheapest number of partitions is taken.
4. A node is sent to one key for each choice of t_i masked bits of partition
   i; nodes within t_i bits of each other in it meet under at least one key.
   What meets is verified on all 64 bits. Crowded keys are split further by
   the same principle inside the task, and a task emits a spanning forest of
   what it finds, never all pairs of a crowd.
5. Components of the links (``components``) are joined back.

Estimates steer only the work: every link is found whatever they are.

Defined cases: null, empty and blank texts have no shingle and fingerprint 0,
linked like any other; shorter texts than a shingle are one shingle; a null
id is no candidate for a component's name (null if no id is known); repeated
rows are rows of one node; an empty table gives no rows; further columns are
kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import fresh, in_turn, partitions, read, row_key, save
from textlens.llm.components import components
from textlens.llm.words import mix, split_pieces

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Work of verifying a pair against that of sending a node to one key.
VERIFY = 0.01
SMALL_RUN, BLOCK = 64, 1024


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    counts, total, carried = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in split_pieces(text):
        words = carried + [w.lower() for w in piece] if carried else b" ".join(piece).lower().split(b" ") if piece else []
        if len(words) < shingle:
            carried = words
            continue
        values = _shingles(words, shingle, digest, seed)
        total += len(values)
        for i in range(0, len(values), 4096):
            counts += _bit_counts(values[i: i + 4096])
        carried = words[len(words) - shingle + 1:] if shingle > 1 else []
    if not total:  # shorter than a shingle
        return digest(b" ".join(carried), seed) if carried else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _shingles(words: list[bytes], k: int, digest, seed: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], seed) for a, b in
                     zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)], np.uint64)


def _bit_counts(values: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the fingerprint as the signed long ``fp``."""
    keep = [c for c in docs.columns if c not in (text, "fp")]
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(fresh(docs, "_text")))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.columns[-1]), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], [*keep, "fp"])

    return rows.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, T.StructField("fp", T.LongType())]))


def moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes and the 65 x 65 sums of products of their bits (as
    +1 and -1, and a constant): 65 rows a task, summed by Spark."""
    cols = [f"c{i}" for i in range(65)]

    def run(batches):
        total = np.zeros((65, 65), np.int64)
        for b in batches:
            fps = b.column("fp").to_numpy()
            for i in range(0, len(fps), 1 << 15):
                x = np.ones((len(part := fps[i: i + (1 << 15)]), 65), np.float32)
                x[:, :64] = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1,
                                          bitorder="little")
                x[:, :64] = x[:, :64] * 2 - 1
                total += np.rint(x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65)), *[pa.array(total[:, i].copy()) for i in range(65)]],
                                         ["row", *cols])

    parts = nodes.select("fp").mapInArrow(run, ", ".join(f"{c} long" for c in ["row", *cols]))
    rows = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in cols]).orderBy("row").collect()
    sums = np.array([r[1:] for r in rows], np.int64).reshape(-1, 65)
    return (int(sums[64, 64]), sums) if len(sums) else (0, np.zeros((65, 65), np.int64))


def plan(n: int, sums: np.ndarray, distance: int = DISTANCE, verify: float = VERIFY) -> list[tuple[list[int], int]]:
    """The cheapest (bits, threshold) list over all numbers of partitions."""
    mean = sums[64, :64] / max(n, 1)
    cov = sums[:64, :64] / max(n, 1) - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = cov / np.outer(dev, dev)
    left, order = set(range(1, 64)), [0]
    while left:  # each next bit is the one most correlated with the last ones
        order.append(max(left, key=lambda b: (np.abs(corr[b, order[-8:]]).sum(), -b)))
        left.remove(order[-1])
    best = None
    for m in range(1, distance + 2):
        groups = [list(map(int, g)) for g in np.array_split(order, m)]
        costs = []
        for g in groups:
            apart = [1.0]
            for b in g:  # distribution of the number of differing bits, were they independent
                d = (1 - mean[b] ** 2) / 2
                apart = [(apart[j] if j < len(apart) else 0) * (1 - d) + (apart[j - 1] * d if j else 0)
                         for j in range(min(len(apart) + 1, distance + 1))]
            c = corr[np.ix_(g, g)]
            free = len(g) / max(float((c * c).sum()) / len(g), 1.0) / len(g)  # share of independent bits
            near = [min(1.0, max(p, 1e-300)) ** free for p in np.cumsum(apart)]
            costs.append([0.0] + [n * comb(len(g), t) + verify * n * n / 2 * near[t] for t in range(distance + 1)])
        table = {0: (0.0, [])}  # thresholds + 1 spent -> (cost, thresholds)
        for c in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, ts) in table.items():
                for s in range(distance + 2 - spent):
                    new = (cost + c[s], [*ts, s - 1])
                    if spent + s not in step or new < step[spent + s]:
                        step[spent + s] = new
            table = step
        cost, ts = table[distance + 1]
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def _masks(chosen: list[tuple[list[int], int]]) -> np.ndarray:
    """One bit mask for each key that a node is sent to."""
    from itertools import combinations
    out = []
    for bits, t in chosen:
        whole = sum(1 << b for b in bits)
        out += [whole & ~sum(1 << b for b in off) for off in combinations(bits, t)]
    return np.array(out, np.uint64)


def _forest(x: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is connected within ``distance`` in ``x``
    (distinct values), not all of them."""
    n = len(x)
    varying = [b for b in range(64) if (x & np.uint64(1 << b)).any() != bool(x[0] & np.uint64(1 << b))
               or ((x >> np.uint64(b)) & np.uint64(1)).min() != ((x >> np.uint64(b)) & np.uint64(1)).max()]
    if n > 2 * BLOCK and len(varying) > 2 * (distance + 1):
        runs = []
        for g in np.array_split(varying, distance + 1):
            value = x & np.uint64(sum(1 << int(b) for b in g))
            o = np.argsort(value, kind="stable")
            cut = np.flatnonzero(np.diff(value[o])) + 1
            runs += [r for r in np.split(o, cut) if len(r) > 1]
        if max(map(len, runs), default=0) <= n // 2:
            for r in runs:
                yield from _forest(x[r], distance)
            return
    root = np.arange(n)
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            near = np.bitwise_count(x[i: i + BLOCK, None] ^ x[None, j: j + BLOCK]) <= distance
            while True:  # the least root within the block's links
                a, b = root[i: i + BLOCK], root[j: j + BLOCK]
                low = np.minimum(a, np.where(near, b[None, :], n).min(1))
                high = np.minimum(b, np.where(near, a[:, None], n).min(0))
                if (low == a).all() and (high == b).all():
                    break
                for at, old, new in ((i, a.copy(), low), (j, b.copy(), high)):
                    moved = np.flatnonzero(new < old)
                    if len(moved):
                        yield x[old[moved]], x[new[moved]]
                        root[at + moved] = np.minimum(root[at + moved], new[moved])
    other = np.flatnonzero(root != np.arange(n))
    yield x[other], x[root[other]]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links among the nodes of each key; the rows come sorted by key."""
    def emit(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def work(key, fp):
        o = np.lexsort((fp, key))
        key, fp = key[o], fp[o]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        key, fp = key[new], fp[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        small = np.repeat(size <= SMALL_RUN, size)
        k, f = key[small], fp[small]
        for s in range(1, SMALL_RUN):
            at = np.flatnonzero(k[s:] == k[:-s])
            if not len(at):
                break
            near = at[np.bitwise_count(f[at] ^ f[at + s]) <= distance]
            if len(near):
                yield emit(f[near], f[near + s])
        for a, n in zip(start[size > SMALL_RUN], size[size > SMALL_RUN], strict=True):
            for u, v in _forest(fp[a: a + n], distance):
                yield emit(u, v)

    keys, fps = [], []
    for b in batches:
        key, fp = (c.to_numpy() for c in b.columns)
        last = np.searchsorted(key, key[-1]) if len(key) else 0  # the last key may go on
        if last or not keys:
            keys.append(key[:last])
            fps.append(fp[:last].view(np.uint64))
            if sum(map(len, keys)):
                yield from work(np.concatenate(keys), np.concatenate(fps))
            keys, fps = [], []
        elif keys[0][0] != key[0]:
            yield from work(np.concatenate(keys), np.concatenate(fps))
            keys, fps = [], []
        keys.append(key[last:])
        fps.append(fp[last:].view(np.uint64))
    if sum(map(len, keys)):
        yield from work(np.concatenate(keys), np.concatenate(fps))


def near_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(``u``, ``v``): links that connect all nodes (``fp``, distinct) which
    chains of steps of at most ``distance`` bits connect."""
    masks = _masks(plan(*moments(nodes), distance))

    def send(batches):
        salt = mix(np.arange(1, len(masks) + 1, dtype=np.uint64))
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            step = max(1, (1 << 18) // len(masks))
            for i in range(0, len(fps), step):
                x = fps[i: i + step]
                key = mix((x[:, None] & masks[None, :]) ^ salt[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)),
                                                  pa.array(np.repeat(x, len(masks)).view(np.int64))], ["key", "fp"])

    sent = nodes.select("fp").mapInArrow(send, "key long, fp long")
    met = sent.repartition(partitions(nodes), "key").sortWithinPartitions("key")
    return met.mapInArrow(lambda it: _links(it, distance), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE,
                    doc_id: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """One narrow row per row of ``docs``: doc_id, fp, component_id and, if
    ``keyed``, ``_k`` (``row_key``)."""
    cols = [F.col(doc_id).alias("doc_id"), *([row_key(F.col(doc_id), F.col(text)).alias("_k")] if keyed else [])]
    rows = save(fingerprints(docs.select(*cols, F.col(text).alias("_t")), shingle, seed, "_t"), "fingerprints")
    nodes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(near_links(nodes, distance))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = save(named.join(least, "root").select("fp", "root", "component_id"), "components")
    return rows.join(named, "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each component: that of the least id (null
    last; one of its repeats). The text is shuffled once."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, keyed=True, **settings)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k")).alias("one"))
    keys = save(first.select(F.col("one._k").alias("_k")), "kept")
    return in_turn(docs, doc_id, text).where("_turn = 1").join(keys, "_k", "left_semi").select("_row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
