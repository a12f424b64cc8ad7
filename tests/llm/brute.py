"""Plain versions of the contracts, one document at a time."""

import hashlib
import re


def contaminated(docs, items, size=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: pattern.findall((t or "").translate(lower))
    windows = {}
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).update([] if item is None else [str(item)])
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        names = sorted(found)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text, size=4):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_components(docs, size=4):
    sets = [(d, shingles(t, size)) for d, t in docs]
    label = {d: d for d, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    by = {}
    for i, (d, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        shared = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(d), root(sets[j][0])))
                label[b] = a
    return [(d, len(s), root(d), root(d) == d) for d, s in sets]
