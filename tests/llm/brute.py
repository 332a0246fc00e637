"""The corpus operators once more, in the plainest form, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

WHITE = re.compile("[\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = [w for w in WHITE.split(lower(text or "")) if w]
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def components(rows: list[tuple]) -> dict:
    """(doc_id, text) to doc_id -> smallest id reachable."""
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    label[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def removed_lines(rows: list[tuple], words: int) -> dict:
    """(doc_id, text) to (doc_id, text) -> numbers of lines in later copies of runs."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: r[0])
    lines = [(d, t.split("\n")) for d, t in docs]
    counts = [[len([w for w in WHITE.split(line) if w]) for line in ls] for _, ls in lines]
    starts = defaultdict(list)
    for x, (_, ls) in enumerate(lines):
        for p, line in enumerate(ls):
            starts[line].append((x, p))
    gone = defaultdict(set)
    for x, (_, ls) in enumerate(lines):
        for p, line in enumerate(ls):
            best = 0
            for y, q in starts[line]:
                if (y, q) >= (x, p):
                    break
                other, n = lines[y][1], 0
                while p + n < len(ls) and q + n < len(other) and ls[p + n] == other[q + n]:
                    n += 1
                best = max(best, n)
            if best and sum(counts[x][p : p + best]) >= words:
                gone[docs[x]].update(range(p, p + best))
    return gone


def without_lines(text: str, gone: set[int]) -> str:
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)


def contamination(text: str | None, items: list[tuple], width: int = 10) -> tuple[int, int, list[str]]:
    """Words, hit words and items of a text."""
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words, hit, found = cut.findall(lower(text or "")), set(), set()
    for item, t in items:
        w = cut.findall(lower(t or ""))
        size = min(width, len(w))
        for k in range(len(w) - size + 1) if w else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[k : k + size]:
                    hit.update(range(p, p + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)
