"""Plain versions of what the operators compute."""

import hashlib
import re
from collections import Counter

import xxhash


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def brute_merkle(text):
    """The root over a text's pieces, and the pieces themselves."""
    pieces = []

    def digest(kind, children):
        return hashlib.blake2b(b"".join(children), digest_size=16, person=kind.encode()).digest()

    def node(part, depth):
        kind, sign = (("document", "\n\n"), ("section", "\n"), ("paragraph", " "))[depth]
        parts = part.split(sign)
        if depth < 2:
            return digest(kind, [node(x, depth + 1) for x in parts])
        own = [" ".join(parts[:4])]
        while parts := parts[4:]:
            own.append(" ".join(parts[:4]))
        pieces.extend(own)
        return digest(kind, [digest("piece", [x.encode()]) for x in own])

    return node(text, 0).hex(), Counter(pieces)


def brute_likeness(a, b):
    """Share of two texts' bytes in pieces that both have; a piece's sign after it counts as a byte of it."""
    (_, x), (_, y) = brute_merkle(a), brute_merkle(b)
    size = lambda pieces: sum(n * (len(p.encode()) + 1) for p, n in pieces.items())
    return 1.0 if a == b else 2 * size(x & y) / (size(x) + size(y))
