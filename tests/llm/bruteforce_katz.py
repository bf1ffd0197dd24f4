"""A dictionary Katz model for the tests."""
import math
import re
from collections import Counter, defaultdict

END, START = "</s>", "<s>"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


class Katz:
    def __init__(self, texts, order, cutoff=5):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            w = [START, *tokens(t)]
            for k in range(1, order + 1):
                for i in range(1, len(w)):
                    if i - k + 1 >= 0 and (k > 1 or i > 0):
                        self.counts[k][tuple(w[i - k + 1:i + 1])] += 1
        self.n = sum(self.counts[1].values())
        self.d = [None]
        for k in range(1, order + 1):
            n = Counter(self.counts[k].values())
            a = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
            d = {}
            for r in range(1, cutoff + 1):
                x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 1.0
                d[r] = x if 0 < x <= 1 else 1.0
            self.d.append(d)
        self.total, self.after = Counter(), defaultdict(list)
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                self.total[g[:-1]] += c
                self.after[g[:-1]].append(g[-1])
        self.lost = 1 - sum(self.d[1].get(c, 1.0) * c for c in self.counts[1].values()) / self.n if self.n else 1.0
        self.alphas = {}

    def p(self, w, h=()):
        if not h:
            c = self.counts[1].get((w,), 0)
            if self.lost <= 1e-15:
                return max(c, 1) / (self.n + 1)
            return self.d[1].get(c, 1.0) * c / self.n if c else self.lost
        if h not in self.after:
            return self.p(w, h[1:])
        if h not in self.alphas:
            k = len(h) + 1
            lost = sum(c * (1 - self.d[k].get(c, 1.0)) for c in (self.counts[k][(*h, x)] for x in self.after[h]))
            total = self.total[h] + (lost <= 0)
            low = 1 - sum(self.p(x, h[1:]) for x in self.after[h])
            self.alphas[h] = ((lost if lost > 0 else 1.0) / total / low, total)
        alpha, total = self.alphas[h]
        c = self.counts[len(h) + 1].get((*h, w), 0)
        return self.d[len(h) + 1].get(c, 1.0) * c / total if c else alpha * self.p(w, h[1:])

    def score(self, text):
        w = [START, *tokens(text)]
        return sum(math.log10(self.p(w[i], tuple(w[max(0, i - self.order + 1):i]))) for i in range(1, len(w)))
