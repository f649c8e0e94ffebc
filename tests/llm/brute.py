"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def shingle_set(text: str | None, width: int) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(sets: dict[int, frozenset], percent: int) -> dict[int, int]:
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def contaminations(docs: dict[int, str], items: dict[int, str], width: int = 5, least: float = 0.8) -> dict[tuple[int, int], float]:
    out: dict[tuple[int, int], float] = {}
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for item, text in items.items():
        target = words(text)
        if not target:
            continue
        k = min(width, len(target))
        goal = grams(target, k)
        for doc, body in docs.items():
            w = words(body)
            for s in range(len(w) - len(target) + 1):
                here = grams(w[s : s + len(target)], k)
                sim = sum((here & goal).values()) / sum((here | goal).values())
                if sim >= least:
                    out[doc, item] = max(out.get((doc, item), 0.0), sim)
    return out


def repeats(docs: list[tuple[int, str | None]], length: int) -> dict[int, bytes]:
    first: dict[bytes, tuple[int, int]] = {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        for s in range(len(raw) - length + 1):
            first.setdefault(raw[s : s + length], (doc, s))
    out = {}
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < (doc, s):
                gone[s : s + length] = b"\1" * length
        out[doc] = bytes(gone)
    return out


def targets(sizes: dict, weights: tuple, share: float, cap: float) -> dict:
    """Excess handed on by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            return full
        rest, weight = total - sum(full.values()), sum(w[s] for s in open_)
        over = {s: cap * sizes[s] for s in open_ if rest * w[s] / weight > cap * sizes[s]}
        if not over:
            return full | {s: rest * w[s] / weight for s in open_}
        full |= over


def verdicts(urls: dict, rules: list[tuple[str, str, str]]) -> dict:
    out = {}
    for page, url in urls.items():
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out[page] = (host, path, best and best[2], best[3] if best else "allow")
    return out


def by_first_words(n: int, seed: int = 0) -> list[str]:
    """Invented words in a fixed order."""
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def grouped(pairs) -> dict:
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    return out
