"""Brute-force components for the SimHash tests."""
import re

from xxhash import xxh64_intdigest


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(texts):
    """The first row of each row's group: rows within 3 bits, and what they reach."""
    fps = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def components(ids, texts):
    own, least = groups(texts), {}
    for g, d in zip(own, ids):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [fingerprint(t) for t in texts], [least.get(g) for g in own]
