"""Plain Python forms of the contracts, one row at a time."""

import re
import zlib
from collections import defaultdict
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def exact_groups(rows):
    """rows: (doc_id, text). doc_id -> (keep_id, group_size, kept, sha)."""
    by = defaultdict(list)
    for d, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    out = {}
    for norm, own in by.items():
        best = min(own)[1]
        for _, d in own:
            out[d] = (best, len(own), d == best, sha256(norm.encode()).hexdigest())
    return out


def shingles(text):
    w = WORD.findall(lower(text or ""))
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def jaccard_components(rows, least=80):
    """rows: (doc_id, text) with distinct ids. doc_id -> (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    shared = defaultdict(int)
    for own in where.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= least * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def mix_targets(sizes, share=1.5, most=2.0):
    """sizes: source -> size. Targets by repeated sharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in free}
        for s in over:
            full[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


def warc_rows(rows, least=100):
    """rows: (page_id, payload bytes) with distinct ids. page_id -> (bytes, digest, type, refers_to)."""
    first = {}
    for p, b in sorted(rows):
        first.setdefault(b, p)
    out = {}
    for p, b in rows:
        again = len(b) >= least and first[b] != p
        out[p] = (len(b), sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None)
    return out
