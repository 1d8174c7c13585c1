"""Substring dedup over bytes with suffix arrays of shards.

Removed is every byte covered by a ``window``-byte string that also starts in
a document with a smaller id. A suffix array finds equal strings inside one
shard, so Spark first brings together what can be equal:

1. Copies: texts that repeat a smaller id's whole text are done, and send
   nothing.
2. Anchors: in each window the ``GRAM``-byte string of least hash, the first of
   equal ones. Equal windows have equal anchors. Each group of texts
   (``groups``) sends every anchor that it has, once for each distinct piece:
   the bytes that the consecutive windows of the anchor cover. Anchors of one
   document alone are dropped.
3. Crowds: an anchor of more than ``HOT_PIECES`` pieces (the edge of a very
   common passage, with other bytes around it in each document) would crowd a
   shard. Its windows are pieces of their own, dealt to sub-shards by their own
   bytes; groups first send four bytes of each window's digest, and then only
   windows that another document has.
4. Shards: pieces of shared anchors go to the anchor's shard, equal ones of a
   group once (those of larger ids are done on the spot). In the shard the
   distinct pieces form one string; its suffix array is built by induced
   sorting (``suffixes``), neighbours are compared in permuted order, and equal
   windows get the least id that holds them. Pieces that meet no other piece
   need no array.
5. The removed stretches go back to the groups.

Texts are shuffled once. Shards and groups follow the bytes of the input; no
step pairs occurrences.

Hashes decide where bytes meet. Pieces are equal if their bytes are, compared
inside the group and again in the shard; windows of different pieces meet in
the suffix array. Only whole texts are equal by a digest (128 bits).

Defined cases: null and empty texts have 0 bytes; texts shorter than the
window lose nothing; a null id is larger than every other; rows that repeat
an id are one document for the rule; an empty table gives no rows. The text
returned is binary, as a removal may split a character. Columns ``n_bytes``,
``n_removed`` and ``n_spans`` replace such columns.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import read
from textlens.llm.groups import GROUP_BYTES, by_bucket, deal, unpack, visit_with
from textlens.llm.suffixes import common_prefixes, suffix_array
from textlens.llm.words import CHUNK, buffer_of, chunks, mix

WINDOW, GRAM = 50, 20
HOT_PIECES = 10_000  # of up to 80 bytes: a fifth of what a shard holds besides
_NULL, _ALONE = np.iinfo(np.int64).max, np.uint64(0x5851F42D4C957F2D)
_PIECE = np.dtype([("key", "<u4"), ("hash", "<u4"), ("doc", "<i8"), ("size", "<u2"), ("places", "<u4")])
_SPAN = np.dtype([("at", "<u4"), ("n", "<u4")])


def _slide(f, x: np.ndarray, w: int) -> np.ndarray:
    """``f`` over every ``w`` consecutive values."""
    y, k = x, 1
    while 2 * k <= w:
        y, k = f(y[:-k], y[k:]), 2 * k
    return y if k == w else f(y[: len(x) - w + 1], y[w - k:][: len(x) - w + 1])


class Group:
    """The texts of a group as one buffer."""

    def __init__(self, table: pa.Table):
        col = table.column("_bytes").cast(pa.large_binary())
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        self.data, self.offsets = buffer_of(col.view(pa.large_string()))
        self.doc = table.column("_id").fill_null(_NULL).to_numpy()
        self.n = len(self.doc)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]: self.offsets[i + 1]].tobytes()

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1


def anchors(g: Group, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows."""
    at, h, _, _ = stretches(g, window)
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def stretches(g: Group, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors, and the stretches (from, to) that their
    windows cover; each window has one anchor and is in one stretch."""
    w, parts = window - GRAM + 1, [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b, off in _pieces(g.offsets, window):
        m = b - a - GRAM + 1
        if b - a < window:
            continue
        data = np.ascontiguousarray(g.data[a:b])
        eight = lambda k: np.ndarray((m,), "<u8", buffer=data, offset=k, strides=(1,))  # noqa: E731, B023
        h = eight(0) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += eight(8) * np.uint64(0xD1342543DE82EF95)
        h ^= h >> np.uint64(31)
        h = mix(h + eight(GRAM - 8) * np.uint64(0xE7037ED1A0B428DB))
        order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        at = (_slide(np.minimum, order, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # anchor of the window that starts here
        whole = np.ones(len(at), bool)
        for end in off[1:]:  # windows that cross the end of a text
            whole[max(end - window + 1, 0): end] = False
        change = at[1:] != at[:-1]
        first = np.flatnonzero(whole & np.concatenate([[True], change | ~whole[:-1]]))
        last = np.flatnonzero(whole & np.concatenate([change | ~whole[1:], [True]]))
        at = at[first]
        parts.append((at + a, h[at], first + a, last + a + window))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _pieces(offsets: np.ndarray, window: int):
    """(start, end, offsets of the rows from start): whole rows, or pieces of a
    long row that share ``window`` - 1 bytes, so each window is in one piece."""
    for lo, hi in chunks(offsets, CHUNK):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * CHUNK:
            yield a, b, offsets[lo: hi + 1] - a
            continue
        for p in range(a, b, CHUNK):
            end = min(p + CHUNK + window - 1, b)
            yield p, end, np.array([0, end - p])
            if end == b:
                break


def _repeated(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values in documents: the distinct ones, which of these more than one
    document has, and the number of each value among them."""
    o = np.lexsort((doc, h))
    first = np.concatenate([[True], h[o][1:] != h[o][:-1]])[: len(o)]
    start = np.flatnonzero(first)
    last = np.append(start[1:], len(o)) - 1 if len(o) else start
    which = np.empty(len(o), np.int64)
    which[o] = np.cumsum(first) - 1
    return h[o][first], doc[o][start] != doc[o][last], which


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h) % np.uint64(n)).astype(np.int32)


def _anchor_id(h: np.ndarray, n: int) -> np.ndarray:
    """What a shard tells anchors apart by: its own number and the short hash."""
    return _bucket(h, n).astype(np.uint64) << np.uint64(32) | _short(h)


def _digests(raw: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)


def whole_copies(rows: DataFrame, window: int) -> DataFrame:
    """(``_db``, ``digest``, ``least``): whole texts of that group that more than
    one id has, and the least of these."""
    doc = F.coalesce(F.col("_id").cast("long"), F.lit(int(_NULL)))
    long = rows.where(F.octet_length("_bytes") >= window).select("_db", F.unhex(F.md5("_bytes")).alias("digest"), doc.alias("doc"))
    some = long.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("top"), F.collect_set("_db").alias("dbs"))
    return some.where("top > least").select(F.explode("dbs").alias("_db"), "digest", "least")


def _copies(g: Group, found: pa.Table, window: int) -> np.ndarray:
    """Rows whose whole text a smaller id has."""
    if not found.num_rows:
        return np.zeros(0, np.uint32)
    least = dict(zip(found.column("digest").to_pylist(), found.column("least").to_pylist(), strict=True))
    long = np.flatnonzero(np.diff(g.offsets) >= window).tolist()
    digest = lambda r: md5(g.text(r), usedforsecurity=False).digest()
    return np.array([r for r in long if g.doc[r] > least.get(digest(r), _NULL)], np.uint32)


def shared_anchors(rows: DataFrame, n: int, window: int, hot_groups: int) -> DataFrame:
    """(``_db``, ``keys``: anchors shared with other groups, ``hot``: those of more
    than ``hot_groups`` pieces, distinct in each group, ``copies``: rows whose
    whole text a smaller id has), packed."""
    def send(table: pa.Table, found: pa.Table) -> pa.Table:
        names = ["bucket", "db", "keys", "known"]
        if not table.num_rows:
            return _table([], names)
        db, g = table.column("_db")[0].as_py(), Group(table)
        copies = _copies(g, found, window)
        name, a, b, which = _anchors_left(g, window, copies)
        own = np.bincount(which)
        many = np.flatnonzero(own[which] > 1)  # places of anchors that occur again
        piece = _digests(g.data.tobytes(), a[many], b[many])
        o = np.lexsort((piece, which[many]))
        again = np.concatenate([[False], (piece[o][1:] == piece[o][:-1]) & (which[many][o][1:] == which[many][o][:-1])])[: len(o)]
        own -= np.bincount(which[many][o][again], minlength=len(name))
        name = np.repeat(name, own)
        out = [(k, db, x.tobytes(), b"") for k, x in by_bucket(_bucket(name, n), _short(name))]
        out.append((db, db, b"", copies.tobytes()))
        return _table(out, names)

    def meet(table: pa.Table) -> pa.Table:
        dbs = table.column("db").to_numpy()
        out = [(int(d), b"", b"", k.tobytes()) for d, k in zip(dbs, unpack(table.column("known"), "<u4"), strict=True) if len(k)]
        parts = unpack(table.column("keys"), "<u4")
        key, db = np.concatenate(parts), np.repeat(dbs, [len(x) for x in parts])
        o = np.lexsort((db, key))
        key, db = key[o], db[o]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        once = new | np.concatenate([[True], db[1:] != db[:-1]])[: len(key)]
        which = np.cumsum(new) - 1
        hot = (np.bincount(which) > hot_groups)[which] & once
        some = (np.bincount(which[once]) > 1)[which] & once & ~hot
        mine = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)
        out += [(d, k.tobytes(), b"", b"") for d, k in by_bucket(db[some], key[some])]
        out += [(d, b"", k.tobytes(), b"") for d, k in by_bucket(db[hot], mine | key[hot])]
        return _table(out, ["_db", "keys", "hot", "copies"])

    sent = visit_with(rows, whole_copies(rows, window), send, "bucket int, db int, keys binary, known binary")
    return sent.groupBy("bucket").applyInArrow(meet, "_db int, keys binary, hot binary, copies binary")


def _anchors_left(g: Group, window: int, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts that are no copies: the distinct anchors, the stretches (from,
    to) of all, and the number of each one's anchor among the distinct ones."""
    at, h, a, b = stretches(g, window)
    left = ~np.isin(g.row_of(at), copies)
    name, which = np.unique(h[left], return_inverse=True)
    return name, a[left], b[left], which


def shared_windows(rows: DataFrame, facts: DataFrame, n: int, window: int) -> DataFrame:
    """(``_db``, ``windows``: short digests of windows of crowded anchors that
    another group has as well)."""
    def send(table: pa.Table, found: pa.Table) -> pa.Table:
        names = ["bucket", "db", "keys"]
        hot = _joined(found, "hot", "<u8")
        if not table.num_rows or not len(hot):
            return _table([], names)
        db, g = table.column("_db")[0].as_py(), Group(table)
        name, a, b, which = _anchors_left(g, window, _joined(found, "copies", "<u4"))
        crowded = np.isin(_anchor_id(name, n), hot)[which]
        at = _windows(a[crowded], b[crowded], window)
        digest = np.unique(_digests(g.data.tobytes(), at, at + window))
        return _table([(k, db, x.tobytes()) for k, x in by_bucket(_bucket(digest, n), _short(digest))], names)

    def meet(table: pa.Table) -> pa.Table:
        dbs, parts = table.column("db").to_numpy(), unpack(table.column("keys"), "<u4")
        key, db = np.concatenate(parts), np.repeat(dbs, [len(x) for x in parts])
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        some = times[which] > 1
        return _table([(d, k.tobytes()) for d, k in by_bucket(db[some], key[some])], ["_db", "windows"])

    sent = visit_with(rows, facts, send, "bucket int, db int, keys binary")
    return sent.groupBy("bucket").applyInArrow(meet, "_db int, windows binary")


def _joined(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *unpack(table.column(column), kind)])


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, pa.int32() if n in ("bucket", "db", "_db") else pa.binary())
                     for n, c in zip(names, cols, strict=True)], names)


def removed_spans(rows: DataFrame, n: int, window: int, hot_groups: int = HOT_PIECES) -> DataFrame:
    """(``_db``, ``spans``: stretches of window starts to remove, packed)."""
    sent = sent_pieces(rows, n, window, hot_groups)
    return sent.groupBy("bucket").applyInArrow(lambda t: _shard(t, window), "_db int, spans binary")


def sent_pieces(rows: DataFrame, n: int, window: int, hot_groups: int = HOT_PIECES) -> DataFrame:
    """What the groups send to the shards: (``bucket``, ``db``, ``heads``, ``bytes``,
    ``places``: of pieces, ``known``: stretches of window starts known here)."""
    facts = shared_anchors(rows, n, window, hot_groups)
    facts = facts.unionByName(shared_windows(rows, facts, n, window), allowMissingColumns=True)

    def send(table: pa.Table, found: pa.Table) -> pa.Table:
        names = ["bucket", "db", "heads", "bytes", "places", "known"]
        if not table.num_rows:
            return _table([], names)
        db, g = table.column("_db")[0].as_py(), Group(table)
        known = [np.zeros(0, _SPAN)]
        copies = _joined(found, "copies", "<u4").astype(np.int64)
        spans = np.zeros(len(copies), _SPAN)
        spans["at"], spans["n"] = g.offsets[copies], g.offsets[copies + 1] - g.offsets[copies] - window + 1
        known.append(spans)
        at, h, left, right = stretches(g, window)
        row = g.row_of(at)
        stays = ~np.isin(row, copies)
        at, h, row, left, right = at[stays], h[stays], row[stays], left[stays], right[stays]
        own, several, which = _repeated(h, g.doc[row])
        hot = np.isin(_anchor_id(own, n), _joined(found, "hot", "<u8"))
        use = ((several | _among(_short(own), np.unique(_joined(found, "keys", "<u4")))) & ~hot)[which]
        raw, out = g.data.tobytes(), []
        alone = _windows(left[hot[which]], right[hot[which]], window)
        own_digest = _digests(raw, alone, alone + window)
        digest, several, which = _repeated(own_digest, g.doc[g.row_of(alone)])
        shared = (several | _among(_short(digest), np.unique(_joined(found, "windows", "<u4"))))[which]
        alone, own_digest = alone[shared], own_digest[shared]
        at, h, row, a, b = at[use], h[use], row[use], left[use], right[use]
        piece = mix(_digests(raw, a, b) ^ mix((at - a).astype(np.uint64)))  # the same bytes around the anchor
        piece, h = np.concatenate([piece, own_digest]), np.concatenate([h, mix(own_digest ^ _ALONE)])
        row, a, b = np.concatenate([row, g.row_of(alone)]), np.concatenate([a, alone]), np.concatenate([b, alone + window])
        doc = g.doc[row]
        while True:
            o = np.lexsort((a, doc, piece, h))
            new = np.concatenate([[True], (piece[o][1:] != piece[o][:-1]) | (h[o][1:] != h[o][:-1])])[: len(o)]
            lead = o[np.flatnonzero(new)][np.cumsum(new) - 1]
            other = np.array([raw[w:x] != raw[y:z] for w, x, y, z in zip(
                a[o].tolist(), b[o].tolist(), a[lead].tolist(), b[lead].tolist(), strict=True)], bool)
            if not other.any():
                break
            piece[o[other]] += np.uint64(1)  # other bytes, same digest
        head = np.flatnonzero(new)
        lead = o[head]
        which = np.cumsum(new) - 1
        least = doc[lead][which]
        later = doc[o] > least  # known here: a smaller id has the same piece
        spans = np.zeros(int(later.sum()), _SPAN)
        spans["at"], spans["n"] = a[o][later], b[o][later] - a[o][later] - window + 1
        known.append(spans)
        count = np.bincount(which[~later], minlength=len(head))
        heads = np.zeros(len(head), _PIECE)
        heads["key"], heads["hash"], heads["doc"] = _short(h[lead]), piece[lead], doc[lead]
        heads["size"], heads["places"] = b[lead] - a[lead], count
        places = a[o][~later].astype(np.uint32)
        first = np.concatenate([[0], np.cumsum(count)])
        for k, i in by_bucket(_bucket(h[lead], n), np.arange(len(head))):
            out.append((k, db, heads[i].tobytes(), b"".join([raw[x:y] for x, y in zip(a[lead[i]].tolist(), b[lead[i]].tolist(), strict=True)]),
                        np.concatenate([places[first[j]: first[j + 1]] for j in i.tolist()]).tobytes(), b""))
        out.append((db, db, b"", b"", b"", np.concatenate(known).tobytes()))
        return _table(out, names)

    return visit_with(rows, facts, send,
                      "bucket int, db int, heads binary, bytes binary, places binary, known binary")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _windows(left: np.ndarray, right: np.ndarray, window: int) -> np.ndarray:
    """Starts of all windows inside the stretches."""
    size = np.maximum(right - left - window + 1, 0)
    return np.repeat(left, size) + _count(size)


def _other_bytes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, lead: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Pieces whose bytes aren't those of the piece ``lead``, a block at a time."""
    check = np.flatnonzero((lead != np.arange(len(lead))) & (size == size[lead]))
    cut = np.searchsorted(np.cumsum(size[check], dtype=np.int64), np.arange(block, size[check].sum(dtype=np.int64) + 1, block))
    parts = [np.flatnonzero(size != size[lead])]
    for i in np.split(check, cut):
        if len(i):
            n = size[i].astype(np.int64)
            unlike = data[np.repeat(begin[i], n) + _count(n)] != data[np.repeat(begin[lead[i]], n) + _count(n)]
            parts.append(i[np.logical_or.reduceat(unlike, np.cumsum(n) - n)])
    return np.concatenate(parts)


def _shard(table: pa.Table, window: int) -> pa.Table:
    """Judge the windows of all pieces that met in a shard."""
    dbs = table.column("db").to_numpy()
    out = [(int(d), s.tobytes()) for d, s in zip(dbs, unpack(table.column("known"), _SPAN), strict=True) if len(s)]
    parts = unpack(table.column("heads"), _PIECE)
    heads, db = np.concatenate(parts), np.repeat(dbs, [len(x) for x in parts])
    if len(heads):
        data = np.concatenate(unpack(table.column("bytes"), np.uint8))
        places = np.concatenate(unpack(table.column("places"), "<u4"))
        begin = np.cumsum(heads["size"], dtype=np.int64) - heads["size"]
        first = np.cumsum(heads["places"], dtype=np.int64) - heads["places"]
        # distinct pieces, and the least id of each
        while True:
            o = np.lexsort((heads["doc"], heads["hash"], heads["key"]))
            k, h = heads["key"][o], heads["hash"][o]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
            lead = o[new]
            piece = np.empty(len(heads), np.int64)
            piece[o] = np.cumsum(new) - 1
            other = _other_bytes(data, begin, heads["size"], lead[piece])
            if not len(other):
                break
            heads["hash"][other] += np.uint32(1)  # other bytes, same digest
        least = heads["doc"][lead]
        windows = heads["size"][lead].astype(np.int64) - window + 1
        base = np.cumsum(windows) - windows
        owner = np.repeat(least, windows)  # least id that holds each window of each distinct piece
        alone = np.concatenate([[True], k[new][1:] != k[new][:-1]]) & np.concatenate([k[new][1:] != k[new][:-1], [True]])
        several = np.flatnonzero(~alone)
        if len(several):
            size = heads["size"][lead[several]].astype(np.int64)
            at = np.cumsum(size + 1) - size - 1  # a separator behind each piece
            s = np.ones(int((size + 1).sum()) + 1, np.uint16)
            src = np.repeat(begin[lead[several]] - at, size) + (inside := np.repeat(at, size) + _count(size))
            s[inside] = data[src].astype(np.uint16) + 2
            s[-1] = 0
            left = np.zeros(len(s), np.int64)  # bytes to the end of the piece
            left[inside] = np.repeat(size, size) - _count(size)
            order = suffix_array(s, 258)
            shared = common_prefixes(s, order)
            order = order[left[order] >= window]
            same = shared[order[1:]] >= window  # then the one before it in all of the array is a window too
            group = np.concatenate([[0], np.cumsum(~same)])
            which = np.repeat(np.arange(len(several)), size + 1)
            which = np.append(which, 0)[order]
            slot = base[several][which] + order - at[which]
            first_of = np.flatnonzero(np.concatenate([[True], ~same]))
            smallest = np.minimum.reduceat(owner[slot], first_of)
            owner[slot] = smallest[group]
        # stretches of removed window starts of each occurrence
        w = windows[piece]
        gone = owner[np.repeat(base[piece], w) + _count(w)] < np.repeat(heads["doc"], w)
        edge = np.zeros(len(gone) + 1, bool)
        edge[np.cumsum(w)] = edge[0] = True
        lo = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
        hi = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
        whose = np.searchsorted(np.cumsum(w), lo, "right")
        shift, n = lo - (np.cumsum(w) - w)[whose], hi - lo
        many = heads["places"][whose].astype(np.int64)
        spans = np.zeros(int(many.sum()), _SPAN)
        spans["at"] = places[np.repeat(first[whose], many) + _count(many)] + np.repeat(shift, many)
        spans["n"] = np.repeat(n, many)
        out += [(d, s.tobytes()) for d, s in by_bucket(np.repeat(db[whose], many), spans)]
    return _table(out, ["_db", "spans"])


def _count(n: np.ndarray) -> np.ndarray:
    """0 to n_i - 1 for each i."""
    n = np.asarray(n, np.int64)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def dedup_bytes(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                group_bytes: int = GROUP_BYTES, hot_groups: int = HOT_PIECES) -> DataFrame:
    """``docs`` with the kept bytes as ``text`` (binary), ``n_bytes`` (before),
    ``n_removed`` and ``n_spans``; anchors of more than ``hot_groups`` pieces,
    distinct in each group, are crowded."""
    if window < GRAM + 8:
        raise ValueError(f"windows need {GRAM + 8} bytes at least")
    docs = docs.drop("n_bytes", "n_removed", "n_spans")
    rows, n = deal(docs, doc_id, text, group_bytes)
    spans = removed_spans(rows, n, window, hot_groups)

    def rewrite(table: pa.Table, found: pa.Table) -> pa.Table:
        kept, n_bytes, n_removed, n_spans = [], [], [], []
        if table.num_rows:
            g = Group(table)
            s = np.concatenate([np.zeros(0, _SPAN), *unpack(found.column("spans"), _SPAN)])
            depth = np.zeros(len(g.data) + 1, np.int32)
            np.add.at(depth, s["at"].astype(np.int64), 1)
            np.add.at(depth, s["at"].astype(np.int64) + s["n"] + window - 1, -1)
            gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
            for a, b in zip(g.offsets[:-1].tolist(), g.offsets[1:].tolist(), strict=True):
                x, cut = g.data[a:b], gone[a:b]
                n = int(np.count_nonzero(cut))
                n_bytes.append(b - a)
                n_removed.append(n)
                n_spans.append(int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1])) if n else 0)
                kept.append((x[~cut] if n else x).tobytes())
        return pa.table([table.column("_row"), pa.array(kept, pa.binary()),
                         *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]],
                        ["_row", "_kept", "n_bytes", "n_removed", "n_spans"])

    counts = ["n_bytes", "n_removed", "n_spans"]
    schema = T.StructType([rows.schema["_row"], T.StructField("_kept", T.BinaryType()),
                           *[T.StructField(c, T.LongType()) for c in counts]])
    return visit_with(rows, spans, rewrite, schema).select("_row.*", F.col("_kept").alias(text), *counts)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document, bytes and runs removed, digest of the rest."""
    out = dedup_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (
  SELECT doc_id, i, substring(x, 2 * i + 1, {2 * WINDOW}) AS w
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {WINDOW} + 1)) AS i FROM doc)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5_number(w)) AS least FROM win) WHERE doc_id > least
), edge AS (
  SELECT doc_id, i, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) >= i - {WINDOW} THEN 0 ELSE 1 END AS new FROM late
), run AS (
  SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge) GROUP BY doc_id, r
), gap AS (
  SELECT d.doc_id, x, r.a, r.b, lag(r.b) OVER (PARTITION BY d.doc_id ORDER BY r.a) AS before
  FROM doc d JOIN run r ON d.doc_id = r.doc_id
), kept AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
         string_agg(substring(x, 2 * coalesce(before, 0)::BIGINT + 1, 2 * (a - coalesce(before, 0))::BIGINT), '' ORDER BY a)
         || substring(any_value(x), 2 * max(b) + 1) AS rest
  FROM gap GROUP BY doc_id
)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, d.x))) AS kept_sha256
FROM doc d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
