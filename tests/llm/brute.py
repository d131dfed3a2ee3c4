"""What the operators must return, computed the plain way."""

from __future__ import annotations

import collections
import hashlib
import re

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, k=4):
    words = WORD.findall(lower(text or ""))
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def components(sets):
    """Smallest id reachable over links of similarity 0.8, for each id of {id: set}."""
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def line_dedup(docs):
    """{id: (lines, dropped, hash)} of (id, text) pairs with different ids."""
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = collections.defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    found = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        found[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return found


def quality_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered), failed


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} of {source: size}; a null source is None."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        new = {s for s in rest if share[s] > most * sizes[s]}
        if not new:
            return {s: share.get(s, most * sizes[s]) for s in names}
        full |= new


def base_spans(text):
    text = text or ""

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0

    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [
        ("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    return spans + [
        ("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def overlaps(docs, items):
    """{(doc id, item id): most equal tokens in a window} by trying every alignment."""
    def tokens(text):
        return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())

    found = {}
    for d, text in docs:
        words = tokens(text)
        for i, item in items:
            item = tokens(item)
            window = min(16, len(item))
            if window < 5:
                continue
            loss = 3 if window >= 16 else 2 if window >= 13 else 1 if window >= 9 else 0
            for shift in range(-len(item) + window, len(words) - window + 1):
                equal = [0 <= j + shift < len(words) and item[j] == words[j + shift] for j in range(len(item))]
                for k in range(max(0, -shift), min(len(item), len(words) - shift) - window + 1):
                    n = sum(equal[k:k + window])
                    if n >= window - loss:
                        found[d, i] = max(n, found.get((d, i), 0))
    return found
