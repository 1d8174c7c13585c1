"""The operators recomputed plainly from their contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def below(doc_id):
    """Null below every id."""
    return (doc_id is not None, doc_id or 0)


def lines(rows, min_chars=40, min_docs=5):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(list)
    for i, r in enumerate(rows):
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    keeper = {k: max((rows[i][0] for i in h), key=below) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for r in rows:
        all_ = (r[1] or "").split("\n")
        left = [x for x in all_ if key(x) not in keeper or keeper[key(x)] == r[0]]
        out.append((r[0], len(all_), len(all_) - len(left), sha("\n".join(left).encode())))
    return out


def leaks(rows, items, window=10):
    def words(t):
        return ALNUM_WORD.findall((t or "").translate(LOWER))
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[i:i + k])].add("null" if item is None else str(item))
    out = []
    for r in rows:
        w, hit, ids = words(r[1]), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                found = wins.get(tuple(w[i:i + k]))
                if found:
                    hit |= set(range(i, i + k))
                    ids |= found
        out.append((r[0], len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    return out


def fingerprint(text, k=3):
    w = [] if text is None else text.encode().lower().split()
    shingles = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if bits[i] * 2 > len(shingles))


def joined(values, near):
    """Index of the least member of each one's component."""
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def simhash(rows, distance=3):
    fps = [fingerprint(r[1]) for r in rows]
    root = joined(fps, lambda a, b: (a ^ b).bit_count() <= distance)
    ids = defaultdict(list)
    for r, c in zip(rows, root, strict=True):
        if r[0] is not None:
            ids[c].append(r[0])
    return [(r[0], f"{f:016x}", min(ids[c], default=None)) for r, f, c in zip(rows, fps, root, strict=True)]


def substrings(rows, window=35):
    words = [[] if r[1] is None else BLANK_WORD.findall(r[1]) for r in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((r[0], len(w), len(gone), sha(" ".join(kept).encode())))
    return out


def byte_runs(rows, window=50):
    texts = [(r[1] or "").encode() for r in rows]
    order = [2**70 if r[0] is None else r[0] for r in rows]
    least = {}
    for t, d in zip(texts, order, strict=True):
        for i in range(len(t) - window + 1):
            s = t[i:i + window]
            least[s] = min(least.get(s, d), d)
    out = []
    for r, t, d in zip(rows, texts, order, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if least[t[i:i + window]] < d:
                gone[i:i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def quality(rows, min_group=50, width=6.0):
    out, rates = [], []
    for r in rows:
        t = r[1] or ""
        w = BLANK_WORD.findall(t)
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        again = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        ln = [x for x in t.split("\n") if BLANK_WORD.search(x)]
        found = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ln) - len(set(ln)), len(again))
        out.append((r[0], *found, len(w) < 50 or 100 * len(again) > 50 * len(w)))
        rates.append([x / max(1, len(ln) if i == 2 else len(w)) for i, x in enumerate(found[1:])])

    def fences(group):
        some = [x for r, x, o in zip(rows, rates, out, strict=True) if o[1] and group(r)]
        if len(some) < min_group:
            return None
        limits = []
        for k, least in enumerate((0.1, 0.02, 0.06, 0.05)):
            v = sorted(x[k] for x in some)
            low, high = (v[-(-len(v) * p // 4) - 1] for p in (1, 3))
            spread = max(high - low, least) * width
            limits.append((low - spread, high + spread))
        return limits

    known = {}
    for i, (r, o) in enumerate(zip(rows, out, strict=True)):
        if (r[2], r[3]) not in known:
            near, wide = fences(lambda x, r=r: x[2:4] == r[2:4]), fences(lambda x, r=r: x[2] == r[2])
            known[r[2], r[3]] = [f for f in (near, wide or fences(lambda x: True)) if f]
        inside = all(a <= x <= z for f in known[r[2], r[3]] for (a, z), x in zip(f, rates[i], strict=True))
        out[i] = (*o, not o[-1] and inside)
    return out


def order_hash(seed, doc_id):
    return hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()


def mixture(rows, weights=(5, 2, 1), epochs=3, seed="mix-1"):
    """taken of each row (a list), with size, source size and target."""
    size = [0 if r[1] is None else len(BLANK_WORD.findall(r[1])) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(z for r, z in zip(rows, size, strict=True) if r[3] == s) for s in names}
    target, free, left = {}, set(names), sum(size)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * total[s]}
        if not over:
            break
        for s in over:
            target[s] = epochs * total[s]
            left -= target[s]
        free -= over
    target |= share
    finish = []
    for s in names:
        mine = sorted((i for i, r in enumerate(rows) if r[3] == s),
                      key=lambda i: (order_hash(seed, rows[i][0]), zlib.crc32((rows[i][1] or "").encode()), size[i]))
        sent = 0
        for e in range(epochs):
            for k, i in enumerate(mine):
                sent += size[i]
                finish.append((sent / weight[s], names.index(s), k, e, i))
    taken, used = [0] * len(rows), 0
    for *_, i in sorted(finish):
        used += size[i]
        if used > sum(size):
            break
        taken[i] += size[i]
    return [(r[0], z, total[r[3]], float(target[r[3]]), t) for r, z, t in zip(rows, size, taken, strict=True)]


def shards(rows, n=8, seed="shards-1"):
    def key(i):
        t = (rows[i][1] or "").encode()
        return order_hash(seed, rows[i][0]), zlib.crc32(t), len(t) + 1
    frac = {}
    for s in {r[3] for r in rows}:
        mine = sorted((i for i, r in enumerate(rows) if r[3] == s), key=key)
        for k, i in enumerate(mine):
            frac[i] = (k + 0.5) / len(mine)
    order = sorted(frac, key=lambda i: (frac[i], rows[i][3] is None, rows[i][3] or "", *key(i)))
    out = []
    for rank, i in enumerate(order):
        shard = ((rank + 1) * n - 1) // len(rows)
        _, crc, size = key(i)
        out.append((rows[i][0], size, crc, shard, rank - shard * len(rows) // n))
    return out


def _trunc_mod(c, n):
    """Remainder with the sign of c, as SQL has it."""
    return c - n * (abs(c) // n) * (1 if c >= 0 else -1)


def _in_order(rows, none):
    """conv_id -> (turn, role, text) in the order that the operators state."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn, none if role is None else role, none if text is None else text))
    md5 = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for v in convs.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, md5(x[1], x[2])))
    return convs


def rebuilt(rows):
    convs = {c: [(r, t) for _, r, t in v] for c, v in _in_order(rows, "").items() if c is not None}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - _trunc_mod(c, 100), [])[:h] + own[h:]
    return out


def trie(convs):
    """Nodes of the trie of conv_id -> [(role, text)]."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        saved[node] = sum(saved[x] for x in below[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return [(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(below[node]), leaves[node], saved[node],
             sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node)).encode())) for node, m in members.items()]


def damaged(rows):
    """conv_id -> damaged (turn, role, text), every original conv_id."""
    out = {}
    for c, turns in _in_order(rows, " ").items():
        out[c] = []
        for turn, role, text in turns:
            how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(how, text)
            out[c] += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return out


def cheapest_repair(turns):
    """(cost, audit, repaired rows) by trying all edits, on the roles' grammar
    as a pattern; and the faults."""
    seen, faults = set(), []
    for _, role, text in turns:
        words = BLANK_WORD.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else
                      "truncated" if words[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    whole = re.compile(r"(s?(ua)+)?")
    begins = re.compile(r"(s?(ua)*u?)?")
    best = {"": (0, "", [])}  # roles so far, shortened -> cheapest
    short = lambda r: r if len(r) < 4 else r[:len(r) - 2]  # noqa: E731  the same may follow
    inserts = [("I", 2, "user"), ("I", 2, "assistant")]

    def inserted(states):
        for _ in range(3):
            for roles, (cost, audit, out) in list(states.items()):
                for letter, price, role in inserts:
                    put(states, roles + role[0], (cost + price, audit + letter, [*out, (role, "")]))
        return states

    def put(states, roles, new):
        if begins.fullmatch(roles):
            roles = short(roles)
            if roles not in states or new[:2] < states[roles][:2]:
                states[roles] = new

    inserted(best)
    for (_, role, text), fault in zip(turns, faults, strict=True):
        after = {}
        for roles, (cost, audit, out) in best.items():
            put(after, roles, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role:
                    put(after, roles + role[0], (cost + more, audit + "K", [*out, (role, text)]))
                for new in ("user", "assistant"):
                    put(after, roles + new[0], (cost + more + 2, audit + "R", [*out, (new, text)]))
        best = inserted(after)
    return (*min((v for r, v in best.items() if whole.fullmatch(r)), key=lambda v: v[:2]), faults)


def repairs(rows):
    out = []
    for c, turns in damaged(rows).items():
        cost, audit, kept, faults = cheapest_repair(turns)
        known = [t for t, _, _ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
        out.append((c, max(known) - min(known) + 1 - len(set(known)) if known else 0,
                    *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    sha("\n".join(f"{r}:{t}" for r, t in kept).encode())))
    return out
