"""Plain versions of what the corpus operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    number = Counter(windows)
    covered = {j for k, w in enumerate(windows) if number[w] > 1 for j in range(k, k + 5)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def in_bands(text, chunk, share, document_bands, chunk_bands):
    packer = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    raw = text.encode()

    def outside(part, bands):
        low, high = [(a, b) for least, a, b in bands if len(part) >= least][-1]
        return not low <= len(part) / len(packer.compress(part)) <= high

    bad = sum(len(raw[k : k + chunk]) for k in range(0, len(raw), chunk) if outside(raw[k : k + chunk], chunk_bands))
    return not outside(raw, document_bands) and bad <= share * len(raw)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def components(texts):
    """Smallest reachable id by id, over links of at least three quarters."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def without_frequent_lines(rows, ratio, least):
    """(host, text) pairs after line dedup."""
    bare = lambda line: line.strip(" \t\n\v\f\r")
    pages, counts = Counter(), Counter()
    for host, text in rows:
        if host is not None:
            pages[host] += 1
            counts.update({(host, bare(x)) for x in (text or "").split("\n") if bare(x)})
    gone = {k for k, n in counts.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for host, text in rows:
        out.append(None if text is None else "\n".join(x for x in text.split("\n") if (host, bare(x)) not in gone))
    return out


def targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by source, shared again and again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        whole = sum(weight[s] for s in order if s not in full) or 1
        goal = {s: most * sizes[s] if s in full else left * weight[s] / whole for s in order}
        over = {s for s in order if goal[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return goal
        full |= over


PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if fits:
                out.append((m.start(), no, kind, m.end()))
    return ",".join(f"{kind}:{begin}:{end}" for begin, _, kind, end in sorted(out))


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
