"""Brute-force forms that the operators are held against."""

import collections
import hashlib
import re
import zlib

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(rows, length=400):
    """(id, bytes, removed, spans, sha256 of the rest) of (id, text) rows, in input order."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len([1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])])
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows, percent=80):
    """(id, set size, smallest id reachable) of (id, text) rows: all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and find(a) != find(b):
                o = len(sets[a] & sets[b])
                if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def targets(sizes, share=1.5, most=2.0):
    """Target of each source by refilling until none is over `most` times its size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    full, total = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > most * sizes[s] + 1e-9]
        if not over:
            return full | {s: left * weight[s] / w for s in open_}
        full |= {s: most * sizes[s] for s in over}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2
