"""Trie of the prefixes that conversations share, with totals of its subtrees.

A node stands for a distinct sequence of first turns (role and text); the
conversations that start with it are its members, and its smallest member and
its depth name it exactly. A node's parent has a smaller or equal smallest
member, so (conversation, depth) serves as an address everywhere.

Totals over subtrees (leaves, saved characters) come by time-forward
processing: nodes are sorted by reverse level order (depth descending, then
smallest member) with Spark's external sort, and each node sends its total to
its parent's address in a priority queue that spills sorted runs to the
task's own scratch file once it holds more than ``HELD`` messages; a node
takes its messages from the queue when its turn comes.

* Within shards: a shard is the subtree below the first node of a path with
  at most ``shard_convs`` members; shards are dealt over the tasks by hash, so
  a prefix that a third of all conversations share is cut into many of them.
* Across shard roots: the totals of shard roots, added up per parent, meet the
  nodes above them (fewer than conversations / ``shard_convs`` on each level),
  which pass through the same queue, in bands of at most ``BAND`` nodes from the deepest up.

Turns are numbered and prefixes hashed (128 bits from an MD5 of role and
text) along range partitions (``ordered``), so one endless conversation
spreads as well; no step collects a conversation or a node's members. Only
the SHA-256 of a node's ending conversations is sequential by definition: ids
are sorted and joined in pieces by many tasks, the pieces of a node are
hashed one after the other as they stream through one task.

Defined cases: turns are ordered by ``turn``, nulls first, those of one turn
by an MD5 of role and text; null roles and texts are empty; rows with a null
conv_id belong to no conversation; repeated rows are turns of their own; an
empty table has no nodes, not even a root; further columns are ignored; a
conv_id that is no integer is a ``ValueError``.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import partitions, read, save
from textlens.llm.ordered import longs, numbered

SHARD_CONVS, BAND, HELD = 4096, 1 << 20, 1 << 20
PIECE_BYTES = 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class MessageQueue:
    """Messages (address, two sums) of the level that is worked on and the one
    above it. They come out by address, added up; more than ``held`` messages
    waiting are sorted and written to a scratch file as one run."""

    def __init__(self, held: int | None = None):
        self.held, self.waiting, self.n, self.runs, self.now, self.spilled = held or HELD, [], 0, [], [], 0

    @staticmethod
    def _merged(parts: list[np.ndarray]) -> np.ndarray:
        m = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        m = m[:, np.argsort(m[0], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], m[0, 1:] != m[0, :-1]])) if m.shape[1] else np.zeros(0, np.int64)
        return np.vstack([m[:1, first], np.add.reduceat(m[1:], first, axis=1)]) if len(first) else m

    def push(self, address: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> None:
        part = self._merged([np.vstack([address, leaves, saved])])
        self.waiting.append(part)
        self.n += part.shape[1]
        if self.n > self.held:
            self.waiting = [self._merged(self.waiting)]
            self.n = self.waiting[0].shape[1]
            if self.n > self.held // 2:
                with tempfile.TemporaryFile() as f:  # gone when the mapping is
                    f.write(self.waiting[0].tobytes())
                    f.flush()
                    self.runs.append(np.memmap(f, np.int64, "r", shape=self.waiting[0].shape))
                self.waiting, self.n, self.spilled = [], 0, self.spilled + 1

    def next_level(self) -> None:
        """What was sent becomes what is taken; nothing may be left over."""
        if any(at < run.shape[1] for run, at in self.now):
            raise ValueError("a message has no receiver")
        self.now = [[run, 0] for run in [self._merged(self.waiting), *self.runs]]
        self.waiting, self.n, self.runs = [], 0, []

    def pop(self, to: int) -> np.ndarray:
        """All messages of this level for addresses up to ``to``."""
        parts = []
        for run in self.now:
            end = int(np.searchsorted(run[0][0], to, "right"))
            parts.append(np.asarray(run[0][:, run[1]:end]))
            run[1] = end
        return self._merged(parts)


def time_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and messages (depth, conv_id, up: the parent's conv_id, stop: the
    total leaves this shard, leaves, saved) sorted by depth descending, then
    conv_id; ``node`` is false for messages from other shards, which come
    before their node. Gives the nodes with their totals."""
    queue, level, early = MessageQueue(), None, np.zeros((3, 0), np.int64)
    for b in batches:
        cols = {c: longs(b.column(c))[0] for c in ("depth", "conv_id", "up", "leaves", "saved")}
        node, stop = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "stop"))
        out = [[], []]
        cut = np.flatnonzero(np.diff(cols["depth"])) + 1
        for a, z in zip([0, *cut], [*cut, b.num_rows], strict=True):
            if a == z:
                continue
            if early.shape[1] and level != cols["depth"][a]:
                raise ValueError("a message has no receiver")
            while level is not None and level > cols["depth"][a]:
                queue.next_level()
                level -= 1
                if queue.now[0][0].shape[1] == 0 and len(queue.now) == 1:
                    level = int(cols["depth"][a])
            level = int(cols["depth"][a])
            conv, sums = cols["conv_id"][a:z], np.vstack([cols["leaves"][a:z], cols["saved"][a:z]])
            is_node = node[a:z]
            got = queue.pop(int(conv[-1]))
            got = MessageQueue._merged([early, got, np.vstack([conv[~is_node], sums[:, ~is_node]])])
            conv, sums = conv[is_node], sums[:, is_node]
            at = np.searchsorted(conv, got[0])
            here = at < len(conv)
            here[here] = conv[at[here]] == got[0][here]
            early = got[:, ~here]  # for the node that the next batch begins with
            sums[:, at[here]] += got[1:, here]
            if early.shape[1] and (early.shape[1] > 1 or len(conv) and early[0, 0] < conv[-1]):
                raise ValueError("a message has no receiver")
            sends = ~stop[a:z][is_node]
            queue.push(cols["up"][a:z][is_node][sends], sums[0, sends], sums[1, sends])
            out[0].append(sums[0])
            out[1].append(sums[1])
        nodes = b.filter(b.column("node"))
        totals = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out]
        yield pa.RecordBatch.from_arrays([*[nodes.column(c) for c in ("depth", "conv_id", "up", "stop")], *totals],
                                         ["depth", "conv_id", "up", "stop", "leaves", "saved"])


_NODE = "depth long, conv_id long, up long, stop boolean, leaves long, saved long"


def _forward(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions(F.desc("depth"), "conv_id", "node").mapInArrow(time_forward, _NODE)


def _messages(done: DataFrame) -> DataFrame:
    """What nodes that end a shard send to their parents, added up."""
    return (done.where("stop and up is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("conv_id"))
            .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            .select("depth", "conv_id", F.lit(None).cast("long").alias("up"), F.lit(False).alias("stop"), "leaves", "saved",
                    F.lit(False).alias("node")))


def subtree_totals(nodes: DataFrame, band: int = BAND) -> DataFrame:
    """(depth, conv_id, leaves, saved) summed over subtrees. ``nodes``: depth,
    conv_id, up, leaves and saved of the node alone, and the shard's root
    (cut_depth, cut_conv; null for the nodes above all shards)."""
    root = (F.col("depth") == F.col("cut_depth")) & (F.col("conv_id") == F.col("cut_conv"))
    cols = ["depth", "conv_id", "up", "stop", "leaves", "saved", "node"]
    below = nodes.where("cut_depth is not null").withColumns({"stop": root, "node": F.lit(True)})
    done = save(_forward(below.repartition(partitions(nodes), "cut_depth", "cut_conv").select(*cols)), "shard-totals")
    above = nodes.where("cut_depth is null").withColumn("node", F.lit(True))
    found, sent = [done], [_messages(done)]
    for lo, hi in _bands(above, band):
        here = above.where(F.col("depth").between(lo, hi)).withColumn("stop", F.col("depth") == lo).select(*cols)
        for m in sent:
            here = here.union(m.where(F.col("depth").between(lo, hi)))
        # one task for a band of several levels; a single level has no order to keep
        here = here.repartition(1) if lo < hi else here.repartition(partitions(nodes), "conv_id")
        done = save(_forward(here), "band-totals")
        found.append(done)
        sent.append(_messages(done))
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out.select("depth", "conv_id", "leaves", "saved")


def _bands(above: DataFrame, band: int) -> list[tuple[int, int]]:
    """Runs of levels of at most ``band`` nodes together, or single levels,
    from the deepest up. One count per level is gathered."""
    out, lo, hi, n = [], None, None, 0
    for r in above.groupBy("depth").count().orderBy(F.desc("depth")).collect():
        if hi is None or n + r["count"] > band:
            out += [] if hi is None else [(lo, hi)]
            hi, n = r["depth"], 0
        lo, n = r["depth"], n + r["count"]
    return out if hi is None else [*out, (lo, hi)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, owner, conv_id) as comma-joined pieces of one owner."""
    held, size, key, first = [], 0, None, None
    rows: list[tuple] = []
    for b in batches:
        for d, o, c in zip(*[b.column(x).to_pylist() for x in ("depth", "owner", "conv_id")], strict=True):
            if held and (key != (d, o) or size > PIECE_BYTES):
                rows.append((*key, first, ",".join(held)))
                held, size = [], 0
            if not held:
                key, first = (d, o), c
            held.append(str(c))
            size += len(held[-1]) + 1
        if rows:
            yield _batch(rows, _PIECE)
            rows = []
    if held:
        yield _batch([(*key, first, ",".join(held))], _PIECE)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as one SHA-256 for each owner."""
    key, sha, rows = None, None, []
    for b in batches:
        for d, o, piece in zip(*[b.column(x).to_pylist() for x in ("depth", "owner", "piece")], strict=True):
            if key == (d, o):
                sha.update(b",")
            else:
                rows += [] if key is None else [(*key, sha.hexdigest())]
                key, sha = (d, o), hashlib.sha256()
            sha.update(piece.encode())
        if rows:
            yield _batch(rows, _HASH)
            rows = []
    if key is not None:
        yield _batch([(*key, sha.hexdigest())], _HASH)


_PIECE = pa.schema([("depth", pa.int64()), ("owner", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
_HASH = pa.schema([("depth", pa.int64()), ("owner", pa.int64()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, owner, ends_sha256) from (depth, owner, conv_id)."""
    order = ["depth", "owner", "conv_id"]
    n = partitions(ends)
    pieces = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "depth long, owner long, first long, piece string")
    return pieces.repartition(n, "depth", "owner").sortWithinPartitions("depth", "owner", "first").mapInArrow(
        _hashes, "depth long, owner long, ends_sha256 string")


def narrow_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, ``_d`` (MD5 of role and text) and ``chars`` of rows with a conv_id."""
    if not isinstance(rows.schema["conv_id"].dataType, _INTEGERS):
        raise ValueError("conv_id has to be an integer")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("_d"),
        F.char_length(text).cast("long").alias("chars"))


def trie(turns: DataFrame, order: list[Column], convs: DataFrame, shard_convs: int = SHARD_CONVS) -> DataFrame:
    """The nodes of narrow turns (conv_id, ``_d``, chars and what ``order``
    needs) and of the conversations ``convs`` (distinct conv_id), turnless
    ones included; columns as ``op11`` returns them."""
    symbols = [F.xxhash64(F.lit(i), "_d").alias(f"s{i}") for i in (1, 2)]
    steps = numbered(turns.select("*", *symbols), "conv_id", order, ["s1", "s2"], name="steps")
    at = [(F.col("_at") + 1).alias("depth"), F.col("_h_s1").alias("k1"), F.col("_h_s2").alias("k2"), "chars"]
    top = [F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2", "chars")]
    steps = save(steps.select("conv_id", *at).union(convs.select("conv_id", *top)), "prefixes")
    key = ["depth", "k1", "k2"]
    found = save(steps.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"),
                                         F.max("chars").alias("chars")), "prefix-nodes")
    # the address of every prefix of every conversation; common prefixes are many rows of one key, which AQE splits
    path = save(steps.drop("chars").join(found, key).select("conv_id", "depth", "owner", "n_convs", "chars"), "paths")
    place = F.struct("depth", "owner")
    each = save(path.groupBy("conv_id").agg(F.max(place).alias("last"),
                                            F.min(F.when(F.col("n_convs") <= shard_convs, place)).alias("cut")), "ends")
    own = path.where("conv_id = owner").drop("owner")
    parents = path.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("up"))
    nodes = own.join(parents, ["conv_id", "depth"], "left")
    children = nodes.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    cuts = each.select("conv_id", F.when(F.col("cut").isNotNull(), F.col("cut")).alias("cut"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").join(cuts, "conv_id").select(
        "conv_id", "depth", "up", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        *[F.when(F.col("n_convs") <= shard_convs, F.col("cut")[a]).alias(f"cut_{b}")
          for a, b in (("depth", "depth"), ("owner", "conv"))])
    nodes = save(nodes, "nodes")
    totals = subtree_totals(nodes.select("depth", "conv_id", "up", "leaves", "saved", "cut_depth", "cut_conv"))
    ends = end_digests(each.select("last.depth", "last.owner", "conv_id"))
    return (nodes.drop("leaves", "saved").join(totals, ["conv_id", "depth"])
            .join(ends.withColumnRenamed("owner", "conv_id"), ["conv_id", "depth"], "left")
            .select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children",
                    F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, shard_convs: int = SHARD_CONVS) -> DataFrame:
    """The trie of conversations as they are (conv_id, turn, role, text)."""
    turns = save(narrow_turns(conversations), "turns")
    return trie(turns, [F.col("turn").asc_nulls_first(), F.col("_d")], turns.select("conv_id").distinct(), shard_convs)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations: each begins with the first turns
    of the conversation at the start of its hundred, h = crc32(conv_id) % 6 of
    them, and goes on with its own after h."""
    turns = save(narrow_turns(read(spark, sf_dir, "conversations")), "turns")
    turns = numbered(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("_d")], name="original")
    convs = save(turns.select("conv_id").distinct(), "conversations")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    start = turns.where((F.col("conv_id") % 100 == 0) & (F.col("_at") < 5)).withColumnRenamed("conv_id", "_base")
    heads = (convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 100).join(start, "_base")  # 5 rows x 199 at most
             .where(F.col("_at") < h).select("conv_id", F.lit(0).alias("part"), "_at", "_d", "chars"))
    tails = turns.where(F.col("_at") >= h).select("conv_id", F.lit(1).alias("part"), "_at", "_d", "chars")
    rebuilt = save(heads.union(tails).withColumnRenamed("_at", "place"), "rebuilt")
    return trie(rebuilt, [F.col("part"), F.col("place")], convs)


OP11_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, [1::BIGINT,2,3,4,5,6,7,8]),
              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
             [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..')]),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS place
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
        FROM conversations WHERE conv_id IS NOT NULL)
), parts AS (
  SELECT c.conv_id, 0 AS part, place, d, chars FROM convs c JOIN turns t ON t.conv_id = c.base AND place < h
  UNION ALL
  SELECT c.conv_id, 1, place, d, chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place >= h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, chars, md5(string_agg(d, '') OVER w) AS node
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY ALL
), tree AS (
  SELECT n.*, u.conv_id AS parent_conv_id, u.node AS parent
  FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.node = p.node
), children AS (
  SELECT parent, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY parent
), totals AS (
  SELECT p.node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((t.n_convs - 1) * t.chars) AS saved
  FROM tree t LEFT JOIN children c ON c.parent = t.node JOIN paths p ON p.conv_id = t.conv_id AND p.depth <= t.depth
  GROUP BY p.node
), ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id) GROUP BY node
)
SELECT t.conv_id::BIGINT AS conv_id, t.depth::BIGINT AS depth, t.parent_conv_id::BIGINT AS parent_conv_id,
       t.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, coalesce(sha256(e.ids), '{_EMPTY}') AS ends_sha256
FROM tree t JOIN totals s ON s.node = t.node LEFT JOIN children c ON c.parent = t.node LEFT JOIN ends e ON e.node = t.node
"""
