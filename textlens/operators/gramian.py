"""Gramian of the presence matrix: how many documents hold each pair of buckets.

Two plans, chosen by the number of buckets V:

* ``dense`` (V up to ``DENSE_LIMIT``): every task adds up the V x V counts of its
  documents and sends them as packed bands of rows; bands are added in two
  levels (some of the tasks, then all), so no task meets every partial.
* ``tiled`` (any V): V is cut into at most ``MOST_TILES`` ranges of buckets, the
  matrix into tiles (range x range, the upper triangle). Documents go to the
  tiles, not pairs to the counts: a batch sends each tile its documents'
  buckets as packed sparse rows, 2 bytes for a bucket, at most ``MOST_TILES``
  times, and the tile's task counts all pairs of the tile as the batches
  stream in. A tile's counts are final; on a large cluster a tile has several
  tasks (``salts``, from the shuffle partitions) and their counts are added
  up. Counts of a narrow tile are a dense block; a wide tile holds the
  distinct pairs, sorted, and spills sorted runs to the task's own scratch
  file beyond ``HELD`` of them.

Both take documents in planes (a fold, say): every pair then has an array of
counts, one per plane, from the same single pass.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DENSE_LIMIT = 2048          # V up to this: a V x V block per task
BLOCK_ROWS = 2048           # documents per matrix product
MOST_TILES, LEAST_WIDTH = 16, 512
DENSE_GAIN = 400            # multiply-adds of a dense product in the time of a counted pair
DENSE_TILE = 1024           # tile width up to this: a dense block of counts
HELD = 4_000_000            # distinct pairs of a wide tile in memory
PAIR_CHUNK = 4_000_000      # pair codes generated before they are counted
SENT = 1 << 15              # buckets of the documents that a packed row holds
TILE_DOCS = 8192            # documents that a tile counts at once
LEVEL = 64                  # partials added up before the last level


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each entry of a column of lists."""
    size = np.nan_to_num(pc.list_value_length(col).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(col)), size), col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(i: np.ndarray, j: np.ndarray, c: np.ndarray, planes: bool) -> pa.RecordBatch:
    """``c``: one row of counts per pair."""
    counts = c if not planes else None
    col = pa.array(counts[:, 0]) if not planes else pa.ListArray.from_arrays(
        pa.array(np.arange(len(c) + 1) * c.shape[1], pa.int32()), pa.array(c.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), col], ["i", "j", "c"])


def _schema(planes: bool) -> str:
    return f"i bigint, j bigint, c {'array<bigint>' if planes else 'bigint'}"


# ------------------------------------------------------------------ dense

def _dense(rows: DataFrame, v: int, n_planes: int, planes: bool) -> DataFrame:
    width = max(1, min(v, (1 << 17) // max(v, 1)))  # rows of a band: about 1 MB

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((n_planes, v, v), np.int64)
        for batch in batches:
            row, bucket = _lists(batch.column(1))
            plane = batch.column(0).to_numpy(zero_copy_only=False)
            for p in np.unique(plane).tolist():
                docs = np.flatnonzero(plane == p)
                place = np.full(len(plane), -1)
                place[docs] = np.arange(len(docs))
                mine = place[row] >= 0
                at, b = place[row[mine]], bucket[mine]
                for start in range(0, len(docs), BLOCK_ROWS):
                    lo, hi = np.searchsorted(at, [start, start + BLOCK_ROWS])
                    x = np.zeros((min(BLOCK_ROWS, len(docs) - start), v), np.float32)
                    x[at[lo:hi] - start, b[lo:hi]] = 1.0
                    g[p] += np.rint(x.T @ x).astype(np.int64)  # exact: counts < 2^24
        part = TaskContext.get().partitionId() % LEVEL
        for band, start in enumerate(range(0, v, width)):
            block = np.ascontiguousarray(g[:, start:start + width])
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([band], pa.int32()), pa.array([part], pa.int32()),
                                                  pa.array([block.tobytes()], pa.binary())], ["band", "part", "counts"])

    def total(table: pa.Table) -> np.ndarray:
        out = None
        for x in table.column("counts"):
            counts = np.frombuffer(x.as_buffer(), np.int64)
            out = counts.copy() if out is None else np.add(out, counts, out=out)
        return out

    def some(table: pa.Table) -> pa.Table:
        return pa.table({"band": table.column("band")[:1], "counts": pa.array([total(table).tobytes()], pa.binary())})

    def every(table: pa.Table) -> pa.Table:
        start = table.column("band")[0].as_py() * width
        g = total(table).reshape(n_planes, -1, v)
        i, j = np.nonzero(g.any(0))
        i, j = i[i + start <= j], j[i + start <= j]
        return pa.Table.from_batches([_pairs(i + start, j, np.ascontiguousarray(g[:, i, j].T), planes)])

    sent = rows.mapInArrow(partial, "band int, part int, counts binary")
    return (sent.groupBy("band", "part").applyInArrow(some, "band int, counts binary")
            .groupBy("band").applyInArrow(every, _schema(planes)))


# ------------------------------------------------------------------ tiled

def tile_width(v: int) -> int:
    return max(LEAST_WIDTH, -(-v // MOST_TILES))


def _offset_type(width: int) -> str:
    return "<u2" if width <= 1 << 16 else "<u4"


_TILE_ROWS = "x int, y int, salt int, plane binary, nx binary, bx binary, ny binary, by binary"


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of documents with about ``SENT`` buckets: a batch of the packed rows
    then has a bounded number of bytes, whatever its number of rows."""
    size = np.nan_to_num(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SENT, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _to_tiles(width: int, salts: int):
    """Each batch's documents, as packed sparse rows for each tile."""
    kind = _offset_type(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        for whole in batches:
            for batch in _cut(whole):
                row, bucket = _lists(batch.column(1))
                plane = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
                at = bucket // width
                own, n = {}, batch.num_rows
                for x in np.unique(at).tolist():  # tiles' ranges, at most MOST_TILES
                    mine = at == x
                    own[x] = np.bincount(row[mine], minlength=n), (bucket[mine] - x * width).astype(kind), row[mine]
                out = []
                for x in own:
                    for y in (y for y in own if y >= x):
                        (nx, bx, rx), (ny, by, ry) = own[x], own[y]
                        both = (nx > 0) & (ny > 0)
                        if both.any():
                            out.append((x, y, salt, plane[both].tobytes(), nx[both].astype("<u4").tobytes(), bx[both[rx]].tobytes(),
                                        *((b"", b"") if x == y else (ny[both].astype("<u4").tobytes(), by[both[ry]].tobytes()))))
                if out:
                    kinds = [pa.int32()] * 3 + [pa.binary()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                     ["x", "y", "salt", "plane", "nx", "bx", "ny", "by"])
    return run


def _codes(plane: np.ndarray, nx: np.ndarray, bx: np.ndarray, ny: np.ndarray, by: np.ndarray, same: bool, width: int,
           n_planes: int, chunk: int) -> Iterator[np.ndarray]:
    """``(i * width + j) * n_planes + plane`` of all pairs of the documents, some
    ``chunk`` at a time; in a tile on the diagonal those with i <= j."""
    doc = np.repeat(np.arange(len(nx)), nx)
    if same:
        first = np.arange(len(bx))
        n = np.repeat(np.cumsum(nx), nx) - first
    else:
        first = np.repeat(np.cumsum(ny) - ny, nx)
        n = np.repeat(ny, nx)
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, "right")))
        m = n[lo:hi]
        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        right = by[np.repeat(first[lo:hi], m) + step].astype(np.int64)
        yield (np.repeat(bx[lo:hi].astype(np.int64) * width, m) + right) * n_planes + np.repeat(plane[doc[lo:hi]], m)
        lo = hi


class _SortedCounts:
    """Counts of codes; sorted runs go to a scratch file beyond ``HELD``."""

    def __init__(self, held: int | None = None):
        self.held = held or HELD
        self.now, self.runs = np.zeros((2, 0), np.int64), []

    def add(self, codes: np.ndarray) -> None:
        new = np.stack(np.unique(codes, return_counts=True)).astype(np.int64)
        self.now = self._sum([self.now, new])
        if self.now.shape[1] > self.held:
            with tempfile.TemporaryFile() as f:  # gone when the mapping is
                f.write(self.now.tobytes())
                f.flush()
                self.runs.append(np.memmap(f, np.int64, "r", shape=self.now.shape))
            self.now = np.zeros((2, 0), np.int64)

    @staticmethod
    def _sum(parts: list[np.ndarray]) -> np.ndarray:
        m = np.concatenate(parts, axis=1)
        m = m[:, np.argsort(m[0], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], m[0, 1:] != m[0, :-1]])) if m.shape[1] else np.zeros(0, np.int64)
        return np.stack([m[0, first], np.add.reduceat(m[1], first)]) if len(first) else m

    def sums(self, group: int) -> Iterator[np.ndarray]:
        """(code, count) in order, cut where ``code // group`` changes."""
        runs = [self.now, *self.runs]
        cuts = np.unique(np.concatenate([r[0][::max(1, self.held // 4)] for r in runs]) // group * group)
        for lo, hi in zip([-1, *cuts], [*cuts, np.iinfo(np.int64).max], strict=True):
            part = self._sum([np.asarray(r[:, np.searchsorted(r[0], lo): np.searchsorted(r[0], hi)]) for r in runs])
            if part.shape[1]:
                yield part


class _Tile:
    def __init__(self, x: int, y: int, width: int, n_planes: int, planes: bool):
        self.x, self.y, self.width, self.n_planes, self.planes = x, y, width, n_planes, planes
        self.held, self.n_held = [], 0
        size = width * width * n_planes
        self.block = np.zeros(size, np.int64) if width <= DENSE_TILE else None
        self.sorted = None if width <= DENSE_TILE else _SortedCounts()

    def receive(self, packed: tuple, chunk: int) -> None:
        """Documents of the tile: ``(plane, nx, bx, ny, by)``."""
        self.held.append(packed)
        self.n_held += len(packed[0])
        if self.n_held >= TILE_DOCS:
            self.flush(chunk)

    def flush(self, chunk: int) -> None:
        if not self.held:
            return
        plane, nx, bx, ny, by = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.n_held = [], 0
        same = self.x == self.y
        if same:
            ny, by = nx, bx
        if self.block is not None and int(nx @ ny) * DENSE_GAIN > len(nx) * self.width ** 2:
            self._product(plane, nx, bx, ny, by)
            return
        for codes in _codes(plane, nx, bx, ny, by, same, self.width, self.n_planes, chunk):
            self.add(codes)

    def _product(self, plane: np.ndarray, nx: np.ndarray, bx: np.ndarray, ny: np.ndarray, by: np.ndarray) -> None:
        """Crowded documents: products of dense 0/1 blocks, plane by plane."""
        counts = self.block.reshape(self.width, self.width, self.n_planes)
        rows = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
        for p in np.unique(plane).tolist():
            place = np.cumsum(plane == p) - 1
            place[plane != p] = -1
            sides = []
            for row, b in zip(rows, (bx, by), strict=True):
                at = place[row]
                sides.append((at[at >= 0], b[at >= 0]))
            for start in range(0, int(place.max()) + 1, BLOCK_ROWS):
                dense = []
                for at, b in sides:
                    lo, hi = np.searchsorted(at, [start, start + BLOCK_ROWS])
                    block = np.zeros((BLOCK_ROWS, self.width), np.float32)
                    block[at[lo:hi] - start, b[lo:hi]] = 1.0
                    dense.append(block)
                g = np.rint(dense[0].T @ dense[1]).astype(np.int64)  # exact: counts < 2^24
                counts[:, :, p] += np.triu(g) if self.x == self.y else g

    def add(self, codes: np.ndarray) -> None:
        if self.block is None:
            self.sorted.add(codes)
        elif len(codes) * 8 > len(self.block):
            self.block += np.bincount(codes, minlength=len(self.block))
        else:
            np.add.at(self.block, codes, 1)

    def batches(self, chunk: int) -> Iterator[pa.RecordBatch]:
        self.flush(chunk)
        if self.block is not None:
            g = self.block.reshape(-1, self.n_planes)
            pair = np.flatnonzero(g.any(1))
            if len(pair):
                yield self._out(pair, g[pair])
            return
        for code, n in self.sorted.sums(self.n_planes):
            pair, at = np.unique(code // self.n_planes, return_inverse=True)
            c = np.zeros((len(pair), self.n_planes), np.int64)
            c[at, code % self.n_planes] = n
            yield self._out(pair, c)

    def _out(self, pair: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return _pairs(pair // self.width + self.x * self.width, pair % self.width + self.y * self.width, c, self.planes)


def _tiled(rows: DataFrame, v: int, n_planes: int, planes: bool, salts: int | None, chunk: int) -> DataFrame:
    width = tile_width(v)
    n = -(-v // width)
    tiles = n * (n + 1) // 2
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salts = max(1, parts // tiles) if salts is None else salts
    kind = _offset_type(width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for b in batches:
            keys = zip(*[c.to_pylist() for c in b.columns[:3]], strict=True)
            for (x, y, salt), *packed in zip(keys, *b.columns[3:], strict=True):
                if key != (x, y, salt):
                    if tile is not None:
                        yield from tile.batches(chunk)
                    key, tile = (x, y, salt), _Tile(x, y, width, n_planes, planes)
                plane, nx, bx, ny, by = (np.frombuffer(p.as_buffer(), t) for p, t in zip(packed, ("<i4", "<u4", kind, "<u4", kind), strict=True))
                nx, ny = nx.astype(np.int64), ny.astype(np.int64)
                tile.receive((plane, nx, bx, ny, by), chunk)
        if tile is not None:
            yield from tile.batches(chunk)

    sent = rows.mapInArrow(_to_tiles(width, salts), _TILE_ROWS)
    out = (sent.repartition(max(1, min(parts, tiles * salts)), "x", "y", "salt").sortWithinPartitions("x", "y", "salt")
           .mapInArrow(count, _schema(planes)))
    if salts == 1:
        return out  # every pair is in one tile
    c = F.array(*[F.sum(F.col("c")[p]) for p in range(n_planes)]) if planes else F.sum("c")
    return out.groupBy("i", "j").agg(c.alias("c"))


def gramian(presence: DataFrame, num_features: int, strategy: str = "auto", plane: str | None = None, n_planes: int = 1,
            salts: int | None = None, pair_chunk: int = PAIR_CHUNK) -> DataFrame:
    """``(i, j, c)`` with ``i <= j`` and c > 0 from rows with the array ``b`` of
    distinct buckets in order; with a column ``plane`` (0 to ``n_planes`` - 1)
    ``c`` is an array of counts, one per plane. ``strategy``: ``dense``,
    ``tiled`` or ``auto``."""
    v = int(num_features)
    if strategy == "auto":
        strategy = "dense" if v <= DENSE_LIMIT else "tiled"
    rows = presence.select((F.lit(0) if plane is None else F.col(plane)).cast("int").alias("plane"), "b")
    if strategy == "dense":
        return _dense(rows, v, n_planes, plane is not None)
    return _tiled(rows, v, n_planes, plane is not None, salts, pair_chunk)
