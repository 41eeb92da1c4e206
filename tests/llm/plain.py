"""The operators once more, in plain Python, to hold them against."""

from __future__ import annotations

import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(UPPER))


def alnum(text):
    return words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(items, size=10):
    found = {}
    for item_id, text in items:
        w = alnum(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add("" if item_id is None else str(item_id))
    return found


def hits(text, found):
    w, hit, items = alnum(text), set(), set()
    for n in {len(k) for k in found}:
        for i in range(len(w) - n + 1):
            if own := found.get(tuple(w[i : i + n])):
                hit.update(range(i, i + n))
                items |= own
    return len(w), len(hit), items


def components(prints, radius=2):
    """Smallest id reachable, of (id, fingerprint) rows."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [least.get(find(i)) for i in range(len(prints))]
