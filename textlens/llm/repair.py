"""Structure repair of conversations by the cheapest edits.

Every row gets a symbol: its role (system, user, assistant by the first
character, or another) and its first fault (blank, a repeat of an earlier row
of the conversation, or truncated). A conversation's symbols are its
signature. The cheapest edits that make the roles read ``(s?(ua)+)?`` depend
on the rest of the signature and on the grammar's state only, so they are
found from the end: the distinct signatures, reversed and sorted by Spark's
range partitioner, share their ends as the paths of a suffix-shared word
graph. A task keeps the nodes of the path it stands on; the next signature
reuses those of the common end, so cost-to-go and best next edit of the four
grammar states are computed once for each node (a suffix of signatures) over
all conversations (again only for the one path at which a range begins). The
best audit follows from reading a signature forward along its nodes: the
cheapest edit, and of equal ones the least letter, which is also the least
audit, as an edit's letter settles which state it leads to.

Rows are put in order along range partitions (``ordered``), repeats found by
the first place of each distinct row, so one endless conversation spreads.
A conversation's signature takes a byte per row, as its audit does in the
result. Texts move once: the repaired rows stream out of an external sort,
audit first, and their SHA-256 (sequential by definition) follows the stream.

Defined cases: rows are ordered by ``turn``, nulls first, those of one turn
by an MD5 of role and text; rows equal in all of it are adjacent repeats; null
roles and texts count as one space; a null conv_id is a conversation of its
own; an empty table has no conversations; a role of no characters is another
role; further columns are ignored; a conv_id that is no integer is a ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import WORD, partitions, read, save
from textlens.llm.ordered import breaks, longs, numbered
from textlens.llm.prefix_trie import _INTEGERS, _batch

#: Costs of the edits; a truncated row that stays costs one more.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 2, 3, 2, 1
#: Roles of a symbol (symbol % 4) and faults (symbol // 4).
ROLES, NO_FAULT, TRUNCATED, BLANK, DUPLICATE = "sua?", 0, 1, 2, 3
START, WANTS_USER, WANTS_ASSISTANT, COMPLETE = range(4)
#: state -> state that a kept row of role s, u, a or another leads to; None: not allowed.
_KEEP = {START: (WANTS_USER, WANTS_ASSISTANT, None, None), WANTS_USER: (None, WANTS_ASSISTANT, None, None),
         WANTS_ASSISTANT: (None, None, COMPLETE, None), COMPLETE: (None, WANTS_ASSISTANT, None, None)}
#: state -> (role, state) that a new role or a new row leads to.
_MAKE = {START: ("user", WANTS_ASSISTANT), WANTS_USER: ("user", WANTS_ASSISTANT),
         WANTS_ASSISTANT: ("assistant", COMPLETE), COMPLETE: ("user", WANTS_ASSISTANT)}
_NEVER = 1 << 60
_SHA_OF_NONE = hashlib.sha256(b"").hexdigest()

Node = tuple[tuple[int, str], ...]  # (cost to go, best edit or "") of each state


def _with_inserts(plain: list[tuple[int, str]]) -> Node:
    """Inserting a row keeps the node; two in a row are needed at most."""
    best = list(plain)
    for state in (WANTS_ASSISTANT, COMPLETE, START, WANTS_USER):
        base = plain if state in (WANTS_ASSISTANT, COMPLETE) else best
        best[state] = min(plain[state], (INSERT + base[_MAKE[state][1]][0], "I"))
    return tuple(best)


END = _with_inserts([(0, ""), (_NEVER, "~"), (_NEVER, "~"), (0, "")])


def before(symbol: int, rest: Node) -> Node:
    """The node of a symbol followed by the suffix of ``rest``."""
    role, fault = symbol % 4, symbol // 4
    plain = []
    for state in range(4):
        options = [(DELETE + rest[state][0], "D")]
        if fault < BLANK:
            extra = STAYS_TRUNCATED * (fault == TRUNCATED)
            options.append((REROLE + extra + rest[_MAKE[state][1]][0], "R"))
            to = _KEEP[state][role]
            options += [] if to is None else [(extra + rest[to][0], "K")]
        plain.append(min(options))
    return _with_inserts(plain)


def steps(audit: str, symbols) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, index of its row or None, new role or None) along an audit."""
    state, i = START, 0
    for edit in audit:
        if edit == "D":
            yield edit, i, None
        elif edit == "K":
            yield edit, i, None
            state = _KEEP[state][symbols[i] % 4]
        else:
            role, state = _MAKE[state]
            yield edit, None if edit == "I" else i, role
        i += edit != "I"


def _audit(signature: bytes, path: list[Node]) -> str:
    """Read a signature forward; ``path[k]`` is the node of its last k symbols."""
    out, state, left = [], START, len(signature)
    while edit := path[left][state][1]:
        out.append(edit)
        if edit == "K":
            state = _KEEP[state][signature[-left] % 4]
        elif edit != "D":
            state = _MAKE[state][1]
        left -= edit != "I"
    return "".join(out)


def cheapest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``reversed`` signatures, sorted, with ``cost``, ``audit`` and ``nodes``
    (how many nodes of the word graph were new)."""
    path, last = [END], b""
    for b in batches:
        rows = []
        for back in b.column("reversed").to_pylist():
            k = len(_common(last, back))
            del path[k + 1:]
            for symbol in back[k:]:
                path.append(before(symbol, path[-1]))
            rows.append((back, path[-1][START][0], _audit(back[::-1], path), len(back) - k))
            last = back
        if rows:
            yield _batch(rows, _AUDIT)


_AUDIT = pa.schema([("reversed", pa.binary()), ("cost", pa.int64()), ("audit", pa.string()), ("nodes", pa.int64())])


def _common(a: bytes, b: bytes) -> bytes:
    """The common beginning, found by halves."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a[:lo]


class _Counted:
    """What is known of a conversation from the rows seen so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.signature, self.faults, self.illegal = conv_id, bytearray(), np.zeros(4, np.int64), 0
        self.low = self.high = None
        self.distinct = 0

    def add(self, code: np.ndarray, turn: np.ndarray) -> None:
        """The next rows' symbols, and their turns without nulls."""
        role = code % 4
        if self.signature:
            role = np.concatenate([[self.signature[-1] % 4], role])
        pair = role[:-1] * 4 + role[1:]
        self.illegal += int(((pair != 1) & (pair != 6) & (pair != 9)).sum())  # su, ua, au
        self.faults += np.bincount(code // 4, minlength=4)
        self.signature += code.astype(np.uint8).tobytes()
        if len(turn):
            self.distinct += int((turn[1:] != turn[:-1]).sum()) + (self.high != turn[0])
            self.low, self.high = turn[0] if self.low is None else self.low, turn[-1]

    def row(self) -> tuple:
        gaps = int(self.high) - int(self.low) + 1 - int(self.distinct) if self.distinct else 0
        return (self.conv_id, min(gaps, (1 << 63) - 1), *[int(self.faults[f]) for f in (BLANK, DUPLICATE, TRUNCATED)],
                self.illegal, bytes(self.signature))


def _per_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature and counts from rows sorted by conversation and place. A row
    of kind 0 before a row says that it is the first one with its content."""
    key, now, mark = None, None, False
    for b in batches:
        rows = []
        conv, null = longs(b.column("conv_id"))
        turn, no_turn = longs(b.column("turn"))
        code, is_row = longs(b.column("code"))[0], longs(b.column("kind"))[0] == 1
        if not len(conv):
            continue
        first = np.concatenate([[mark], ~is_row[:-1]])  # the row before is a mark
        mark = not is_row[-1]
        code = np.where(~first & (code // 4 != BLANK), code % 4 + 4 * DUPLICATE, code)[is_row]
        conv, null, turn, no_turn = conv[is_row], null[is_row], turn[is_row], no_turn[is_row]
        cut = np.flatnonzero(breaks(conv, null))
        for a, z in zip(cut, [*cut[1:], len(conv)], strict=False):
            if key != (conv[a], null[a]):
                rows += [] if now is None else [now.row()]
                key, now = (conv[a], null[a]), _Counted(None if null[a] else int(conv[a]))
            now.add(code[a:z], turn[a:z][~no_turn[a:z]])
        if rows:
            yield _batch(rows, _CONV)
    if now is not None:
        yield _batch([now.row()], _CONV)


_CONV = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")],
                   ("signature", pa.binary())])


def _prepared(rows: DataFrame) -> DataFrame:
    """Columns that the steps need; ``_order`` breaks the ties of a turn."""
    if not isinstance(rows.schema["conv_id"].dataType, _INTEGERS):
        raise ValueError("conv_id has to be an integer")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return rows.withColumn("_order", _identity(F.col("role"), F.col("text")))


def _identity(role, text) -> F.Column:
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit and ``signature`` (a byte per row), of prepared rows."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    end = F.regexp_extract("text", r"([.!?])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(end == "", TRUNCATED).otherwise(NO_FAULT)
    narrow = save(rows.select("conv_id", "turn", "_order", _identity(F.col("role"), F.col("text")).alias("_d"),
                              (fault * 4 + role).cast("long").alias("code")), "symbols")
    placed = numbered(narrow, "conv_id", [F.col("turn").asc_nulls_first(), F.col("_order"), F.col("_d")], name="placed")
    firsts = placed.groupBy("conv_id", "_d").agg(F.min("_at").alias("_at")).select(
        "conv_id", "_at", F.lit(0).cast("long").alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("code"))
    both = placed.select("conv_id", "_at", F.lit(1).cast("long").alias("kind"), "turn", "code").union(firsts)
    each = save(both.repartition(partitions(rows), "conv_id").sortWithinPartitions("conv_id", "_at", "kind").mapInArrow(
        _per_conversation, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature binary"),
        "signatures")
    # a row that has to go is alike whatever its role
    back = F.reverse(F.translate(F.col("signature").cast("string"), "".join(map(chr, range(9, 16))), chr(8) * 7)).cast("binary")
    each = each.withColumn("reversed", back)
    distinct = each.select("reversed").distinct().repartitionByRange(partitions(rows), "reversed").sortWithinPartitions("reversed")
    found = save(distinct.mapInArrow(cheapest, "reversed binary, cost long, audit string, nodes long"), "word-graph")
    return each.join(found, "reversed").drop("reversed", "nodes")  # a common signature is a hot key: AQE splits it


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply each conversation's audit (kind 0) to the rows that follow it."""
    key, plan, place = None, iter(()), 0

    def until_row(out: list) -> tuple[str, str | None]:
        """Emit inserted rows up to the next edit that takes a row."""
        nonlocal place
        for edit, i, role in plan:
            if i is not None:
                return edit, role
            out.append((key, place, edit, role, ""))
            place += 1
        return "", None

    for b in batches:
        out: list = []
        for conv, kind, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")], strict=True):
            if kind == 0:
                until_row(out)  # what the conversation before ends with
                key, plan, place = conv, steps(role, text.encode()), 0
                continue
            edit, new = until_row(out)
            if edit != "D":
                out.append((key, place, edit, new or role, text))
                place += 1
        if out:
            yield _batch(out, _ROW)
    out = []
    until_row(out)
    if out:
        yield _batch(out, _ROW)


_ROW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    # symbols are below 16, so a signature is also a string of as many characters
    plans = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("_order"),
                         F.col("audit").alias("role"), F.col("signature").cast("string").alias("text"))
    both = plans.union(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "_order", "role", "text"))
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "_order", _identity(F.col("role"), F.col("text"))]
    return both.repartition(partitions(rows), "conv_id").sortWithinPartitions(*order).mapInArrow(
        _edited, "conv_id long, place long, edit string, role string, text string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``audits`` of conversations (conv_id, turn, role, text), written once,
    and their repaired rows: conv_id, place (gapless from 0), edit (Keep,
    Rerole, Insert), role, text; a conversation's rows come together and in order."""
    rows = _prepared(rows)
    found = save(audits(rows), "audits")
    return found, _repaired(rows, found)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha, rows = None, None, []
    for b in batches:
        for conv, place, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")], strict=True):
            if place == 0:
                rows += [] if sha is None else [(key, sha.hexdigest())]
                key, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if rows:
            yield _batch(rows, _SHA)
            rows = []
    if sha is not None:
        yield _batch([(key, sha.hexdigest())], _SHA)


_SHA = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the contract damages them; ``_order`` is that of the rows before."""
    rows = _prepared(conversations)
    of = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                  F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_how", F.crc32(of.cast("binary")) % 20).where("_how <> 0")
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_how") == 4, "user").otherwise(F.col("role")),
                             "_copy": F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})
    return rows.drop("_how", "_copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit and digest of the cheapest repair of every conversation, damaged before."""
    conversations = read(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    found = save(audits(rows), "audits")
    digests = _repaired(rows, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    ids = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = found.drop("signature")
    out = (ids.join(found, ids["_id"].eqNullSafe(found["conv_id"]), "left").drop("conv_id")
           .join(digests, F.col("_id").eqNullSafe(digests["conv_id"]), "left"))
    return out.select(F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(_SHA_OF_NONE)).alias("repaired_sha256"))


def _sql_node(rest: str, symbol: str) -> str:
    """SQL of the node before ``rest``: for each state a text of the cost, in
    eight digits, and the audit, so that the least text is the best."""
    def add(node: str, cost: str, letter: str) -> str:
        return f"(printf('%08d', substr({node}, 1, 8)::INTEGER + {cost}) || '{letter}' || substr({node}, 9))"

    def to(state: int, name: str = rest) -> str:
        return f"{name}[{state + 1}]"

    plain = []
    for state in range(4):
        keeps = " ".join(f"WHEN {symbol} % 4 = {role} THEN {add(to(next_), f'{symbol} // 4', 'K')}"
                         for role, next_ in enumerate(_KEEP[state]) if next_ is not None)
        plain.append(f"least({add(to(state), str(DELETE), 'D')}, CASE WHEN {symbol} // 4 < {BLANK} THEN least("
                     f"{add(to(_MAKE[state][1]), f'{REROLE} + {symbol} // 4', 'R')}, CASE {keeps} ELSE '~' END) ELSE '~' END)")
    made = [f"least({to(s, 'p')}, {add(to(WANTS_ASSISTANT + COMPLETE - s, 'p'), str(INSERT), 'I')})" for s in (WANTS_ASSISTANT, COMPLETE)]
    begun = [f"least({to(s, 'p')}, {add(made[0], str(INSERT), 'I')})" for s in (START, WANTS_USER)]
    return f"list_transform([[{', '.join(plain)}]], lambda p: [{', '.join(begun + made)}])[1]"


OP12_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, [1::BIGINT,2,3,4,5,6,7,8]),
              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         md5(length(coalesce(role, ' ')) || ':' || coalesce(role, ' ') || coalesce(text, ' ')) AS o,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x)::BIGINT FOR x IN regexp_extract_all(
               hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..')]),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how
  FROM conversations, crc_table
), placed AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, o, copy) AS place
  FROM original, range(2) r(copy) WHERE how <> 0 AND (copy = 0 OR how = 3)
), rowed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
         substr(role, 1, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body,
         lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS next_initial
  FROM placed
), marked AS (
  SELECT *, CASE WHEN body = '' THEN {BLANK} WHEN again THEN {DUPLICATE}
                 WHEN body[-1] NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE {NO_FAULT} END AS fault
  FROM rowed
), each AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
         count(*) FILTER (fault = {TRUNCATED}) AS truncated,
         count(*) FILTER (next_initial IS NOT NULL AND initial || next_initial NOT IN ('su', 'ua', 'au')) AS illegal,
         list(fault * 4 + coalesce(nullif(strpos('sua', initial), 0), 4) - 1 ORDER BY place DESC) AS symbols,
         list({{'role': role, 'text': text, 'initial': initial}} ORDER BY place) AS said
  FROM (SELECT * REPLACE (CASE WHEN initial = '' THEN '-' ELSE initial END AS initial) FROM marked) GROUP BY conv_id
), best AS (
  SELECT *, list_reduce(list_prepend(['00000000', '00000004II', '00000002I', '00000000'], [[s::VARCHAR] FOR s IN symbols]),
                        lambda n, k: {_sql_node('n', 'k[1]::INTEGER')})[1] AS found
  FROM each
), edits AS (
  SELECT conv_id, substr(found, 9) AS audit, said, unnest(range(1, length(found) - 7)) AS i FROM best
), made AS (
  SELECT conv_id, i, substr(audit, i, 1) AS edit,
         said[(length(replace(substr(audit, 1, i), 'I', '')))::INTEGER] AS line,
         length(replace(substr(audit, 1, i), 'D', ''))
         - CASE WHEN regexp_matches(audit, '^D*K') AND said[(length(regexp_extract(audit, '^D*')) + 1)::INTEGER].initial = 's'
                THEN 1 ELSE 0 END AS place
  FROM edits
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN line.role ELSE CASE place % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
                                    || ':' || CASE edit WHEN 'I' THEN '' ELSE line.text END, chr(10) ORDER BY i)) AS sha
  FROM made WHERE edit <> 'D' GROUP BY conv_id
)
SELECT c.conv_id::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(found, 1, 8)::BIGINT, 0) AS cost,
       coalesce(substr(found, 9), '') AS audit, coalesce(sha, '{_SHA_OF_NONE}') AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
