"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)


def duplicate_groups(rows, percent=75):
    """doc_id -> smallest doc_id reachable, for rows (doc_id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    by, common, groups = defaultdict(list), Counter(), Union()
    for i, s in sorted(sets.items()):
        for x in s:
            for other in by[x]:
                common[other, i] += 1
            by[x].append(i)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def repeated(rows, length=50):
    """doc_id -> (bytes, removed, spans, digest of the rest)."""
    seen, result = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        own = [raw[k : k + length] for k in range(len(raw) - length + 1)]
        for k, piece in enumerate(own):
            if piece in seen:
                mark[k : k + length] = b"\1" * length
        seen.update(own)
        spans = sum(1 for k, m in enumerate(mark) if m and (k == 0 or not mark[k - 1]))
        rest = bytes(b for b, m in zip(raw, mark) if not m)
        result[i] = (len(raw), sum(mark), spans, hashlib.sha256(rest).hexdigest())
    return result


def lines_removed(rows, similarity=0.75, least=1):
    """doc_id -> numbers of the lines that an earlier line equals or resembles."""
    kept, by, result = [], defaultdict(list), {}
    for i, text in sorted(rows):
        result[i] = []
        for n, line in enumerate((text or "").split("\n")):
            w = [x for x in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if x]
            if len(w) < least:
                continue
            own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            common = Counter(m for x in own for m in by[x])
            if any(c >= similarity * (len(own) + len(kept[m]) - c) for m, c in common.items()):
                result[i].append(n)
            for x in own:
                by[x].append(len(kept))
            kept.append(own)
    return result


def leaks(rows, items, similarity=0.75):
    """{(doc_id, item_id): (similarity, first word)} over all windows of the item's size."""
    found = {}
    bag = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    for i, text in rows:
        own = bag((text or "").lower().split())
        for item, passage in items:
            wanted = Counter(bag((passage or "").lower().split()))
            if not wanted or not set(own) & set(wanted):
                continue
            m = sum(wanted.values())
            size = min(m, len(own))
            best = (0.0, 0)
            for start in range(len(own) - size + 1):
                both = sum((Counter(own[start : start + size]) & wanted).values())
                best = max(best, (both / (m + size - both), -start))
            if best[0] >= similarity:
                found[i, item] = (round(best[0], 6), -best[1])
    return found


BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def base_licenses(text):
    """Words, places, first and last place and labels of the base phrases."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split(" ")
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def base_scores(rows):
    """doc_id -> (held out, tokens, known tokens, base score), and the training tokens."""
    count, tokens = Counter(), {}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    for i, text in rows:
        tokens[i] = [*words(text), None]
        if not out[i]:
            count.update(tokens[i])
    n, v = sum(count.values()), len(count)
    score = lambda t: sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
    return {i: (out[i], len(t), sum(count[x] > 0 for x in t), score(t)) for i, t in tokens.items()}, n
