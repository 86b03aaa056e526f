"""Plain versions of the operators, to hold the Spark results against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def words(text, lower=False) -> list[bytes]:
    raw = (text or "").encode()
    return (bytes(b + 32 if 65 <= b <= 90 else b for b in raw) if lower else raw).split()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def suffix_dedup(texts: list, size: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + size] for b in raw for p in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if seen[b[p:p + size]] > 1:
                gone[p:p + size] = True
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def substring_dedup(rows: list[tuple], size: int) -> list[tuple]:
    first: dict = {}
    key = {i: -2**63 if i is None else i for i, _ in rows}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - size + 1):
            at = (key[i], p)
            k = tuple(w[p:p + size])
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p:p + size])] < (key[i], p):
                gone[p:p + size] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def shingles(text, size: int) -> set:
    w = words(text, lower=True)
    return {tuple(w[p:p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def jaccard(rows: list[tuple], size: int, percent: int):
    """Components and linked pairs, every document held against every other."""
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))
    pairs = set()

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        common: Counter = Counter()
        for x in s:
            common.update(holders[x])
            holders[x].append(k)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                pairs.add((j, k))
                a, b = top(k), top(j)
                group[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k in range(len(rows)):
        least[top(k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min(least[top(k)])) for k in range(len(rows))], pairs


def line_dedup(rows: list[tuple], window: int = 3) -> list[tuple]:
    first: dict = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        for p in range(len(lines) - window + 1):
            k = tuple(lines[p:p + window])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - window + 1):
            k = tuple(lines[p:p + window])
            if "".join(k).strip(" \t\n\x0b\x0c\r") and first[k] < (i, p):
                gone.update(range(p, p + window))
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)))
    return out


def nearest(ids, points, k: int, every: int) -> dict[int, list[tuple]]:
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def quality(text, window=5):
    """Measures and the base verdict of one text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(words) - window + 1):
        where.setdefault(tuple(words[i:i + window]), []).append(i)
    again = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + window)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), failed)


def collocations(rows, least, contained, first):
    """``rows`` of (lang, text); plain counting of every phrase."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for lang in sorted({l or "und" for l, t in rows}):
        f, n = Counter(), 0
        for l, t in rows:
            if (l or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(lower)):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    n += len(w)
                    f.update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        found = [p for p in f if len(p) > 1 and f[p] >= least]
        inside = {}
        for p in found:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside.get(p[i:i + k], 0), f[p])
        scored = []
        for p in found:
            if 100 * inside.get(p, 0) < contained * f[p]:
                score, cut = min((2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -f[p], " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, r, p.decode(), -a, l, g, n, -s) for r, (s, a, p, l, g) in enumerate(sorted(scored)[:first], 1)]
    return out


def alignment(docs, first, second, byte_of, pieces):
    """``first`` and ``second`` encode a text; ``byte_of`` and ``pieces`` give the bytes of an id."""
    groups, count = {}, Counter()
    for row, (i, text) in enumerate(docs):
        a, b, out, ga, gb, da, db = [], [], [], [], [], b"", b""
        if text:
            a, b = first(text), second(text)
            want = (" " + text).encode()
            if b"".join(map(byte_of, a)) != want or b"".join(map(pieces, b)) != want:
                a, b = [], []
        a, b, n_a, n_b = list(a), list(b), len(a), len(b)
        while a or b:
            if len(da) <= len(db):
                ga.append(a.pop(0))
                da += byte_of(ga[-1])
            else:
                gb.append(b.pop(0))
                db += pieces(gb[-1])
            if len(da) == len(db):
                out.append((ga, gb))
                count[ga[-1], gb[-1]] += 1
                ga, gb = [], []
        groups[row] = (i, n_a, n_b, out)
    best = {}
    for (x, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for i, n_a, n_b, out in groups.values():
        links = [(g[-1], h[-1]) for g, h in out]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in out)
        rows.append((i, n_a, n_b, len(out), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                     digest(text.encode()) if out else ""))
    return rows
