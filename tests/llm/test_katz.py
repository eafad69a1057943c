import math
import zlib
from collections import Counter, defaultdict

from fixtures import odd_documents, odd_rows, prose

from tallyglass.llm import katz as K


def discounts(counts):
    n = Counter(counts.values())
    out, common = {}, (K.K + 1) * n[K.K + 1] / n[1] if n[1] else 1
    for r in range(1, K.K + 1):
        share = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if n[r] and n[r + 1] and common < 1 else 1
        out[r] = share if 0 < share < 1 else 1
    return out


class Brute:
    def __init__(self, texts):
        self.tokens = [(i, [*(t or "").encode().lower().split(), "end"], zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0) for i, t in texts]
        self.one, self.two = Counter(), Counter()
        for _, w, held in self.tokens:
            if not held:
                self.one.update(w)
                self.two.update(zip(["end"] + w, w))
        self.n = sum(self.one.values())
        self.d1, self.d2 = discounts(self.one), discounts(self.two)
        self.lost = sum((1 - self.d1.get(c, 1)) * c for c in self.one.values()) / self.n
        self.scale = 1 if self.lost > 0 else self.n / (self.n + 1)
        self.lost = self.lost or 1 / (self.n + 1)
        self.after = defaultdict(list)
        for (h, w), c in self.two.items():
            self.after[h].append((w, c))

    def word(self, w):
        return self.scale * self.d1.get(self.one[w], 1) * self.one[w] / self.n if self.one[w] else self.lost

    def pair(self, h, w):
        total, freed = self.one[h], sum((1 - self.d2.get(c, 1)) * c for _, c in self.after[h])
        bare = all(c > K.K for _, c in self.after[h])
        if c := self.two[(h, w)]:
            return self.d2.get(c, 1) * c / (total + bare)
        if not total:
            return self.word(w)
        return (freed / total if freed > 0 else 1 / (total + 1)) / (1 - sum(self.word(x) for x, _ in self.after[h])) * self.word(w)


def test_scores_match_brute_force(spark):
    texts = odd_rows() + [(100 + i, prose(i % 7, 80 + i, 60)) for i in range(60)]
    brute = Brute(texts)
    docs = odd_documents(spark, texts).repartition(3)
    rows = K.score(docs, settings=K.Settings(chunk_tokens=3000, context_split=40)).collect()
    assert len(rows) == len(texts)
    want = defaultdict(list)
    for i, w, held in brute.tokens:
        score = sum(math.log10(brute.pair(h, x)) for h, x in zip(["end"] + w, w))
        base = sum(math.log10((brute.one[x] + 0.1) / (brute.n + 0.1 * (len(brute.one) + 1))) for x in w)
        want[i].append((held, len(w), sum(brute.one[x] > 0 for x in w), score, base))
    for r in rows:
        held, n, known, score, base = want[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, brute.n)
        assert math.isclose(r["score"], score, rel_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    for h in ["end", *list(brute.after)[:20]]:
        if sum((1 - brute.d2.get(c, 1)) * c for _, c in brute.after[h]) or all(c > K.K for _, c in brute.after[h]):
            assert math.isclose(sum(brute.pair(h, w) for w in brute.one) + brute.pair(h, "never"), 1)
    assert K.score(docs.limit(0)).count() == 0
