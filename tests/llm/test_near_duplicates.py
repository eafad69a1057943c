from collections import Counter

import numpy as np
from fixtures import odd_documents, odd_rows, prose, words
from pyspark.sql import functions as F

from tallyglass.llm import common as C
from tallyglass.llm import near_duplicates as N


def brute(a, b):
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in {*a, *b}) for i in a if b[i])


def as_arrays(counter):
    items = sorted(counter.items())
    return np.array([k for k, _ in items], np.uint64), np.array([n for _, n in items])


def test_similarity_and_signatures():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = Counter(rng.integers(0, 30, 40).tolist()), Counter(rng.integers(0, 30, 40).tolist())
        x, y = as_arrays(a), as_arrays(b)
        exact = N.probability_jaccard(x, y)
        assert abs(exact - brute(a, b)) < 1e-9
        keys, n = [], 40
        for s in (x, y):
            k = np.concatenate([N.mix(s[0] + np.uint64(100 * i)) for i in range(n)])
            keys.append(N.signatures(k, np.tile(s[1], n), np.repeat(np.arange(n), len(s[0])), n, 160))
        assert abs((keys[0] == keys[1]).mean() - exact) < 0.05


def components(texts):
    runs = {i: Counter(hash(tuple(w[j : j + 5])) for j in range(max(1, len(w) - 4))) for i, t in texts.items() if (w := words(t.lower()))}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in runs:
        for b in runs:
            if a < b and find(a) != find(b):
                small, large = sorted((sum(runs[a].values()), sum(runs[b].values())))
                if small > 0.4 * large and sum((runs[a] & runs[b]).values()) > 0.4 * large and brute(runs[a], runs[b]) >= 0.8:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in texts}


def test_classes_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [prose(s, 120) for s in range(3)]
    texts, k = {}, 0
    for edits in (1, 2, 3, 6, 12):
        for b in base:
            for _ in range(6):
                w = b.split(" ")
                for at in rng.integers(0, len(w), edits):
                    w[at] = f"new{rng.integers(1000)}"
                texts[k] = " ".join(w)
                k += 1
    texts |= {k + i: b for i, b in enumerate(base * 2)}
    found = N.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == components(texts)
    assert len(found) == len(texts) and all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = N.classes(docs).collect()
    assert len(rows) == len(odd_rows())
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert got[7] == 1 and got[8] == 1 and got[12] == 5 and all(got[i] == i for i in (1, 2, 3, 4, 5, 6, 9, 10, 11)) and None in got
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 9, 10, 11]
    assert N.classes(docs.limit(0)).count() == 0


def test_repeated_null_and_shared_ids(spark):
    a, b, c, d = (prose(40 + i, 120) for i in range(4))
    near_b = b.replace(b.split(" ")[50], "changed", 1)
    rows = [(9, a), (9, a), (None, a), (None, b), (None, near_b), (None, c), (None, c), (5, a), (5, d), (6, d.upper()), (2, c), (3, None), (3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in N.classes(docs).select("doc_id", "class_id", "kept").collect()]
    want = [(9, 5, False), (9, 5, False), (None, 5, False), (None, None, True), (None, None, True), (None, 2, False), (None, 2, False), (5, 5, True), (5, 5, True), (6, 5, False), (2, 2, True), (3, 3, True), (3, 3, True), (None, None, True)]
    assert Counter(found) == Counter(want)
    kept = [tuple(r) for r in N.one_of_each_class(docs).collect()]
    left = [x for x in kept if x not in ((None, b), (None, near_b))]
    assert Counter(left) == Counter([(5, a), (5, d), (2, c), (3, None), (3, None), (None, "")]) and len(kept) == len(left) + 1
    again = [(9, a), (9, a), (None, b), (None, b), (3, "x"), (4, " X")]
    one = N.one_of_each_class(spark.createDataFrame(again, "doc_id long, text string")).collect()
    assert Counter(map(tuple, one)) == Counter([(9, a), (None, b), (3, "x")])


def test_a_line_that_most_texts_share_pairs_nobody(spark):
    """Texts of a common line and words of their own lie below the threshold, some pairs above; no link is lost."""
    line, rng = prose(70, 90), np.random.default_rng(5)
    texts = {}
    for i in range(60):
        own = " ".join(f"own{i}x{rng.integers(10_000)}" for _ in range(24))
        texts[3 * i] = line + " " + own
        if i % 4 == 0:
            texts[3 * i + 1] = line + " " + own + f" tail{i}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in N.classes(docs).collect()} == components(texts)
    runs = docs.select(F.col("doc_id").alias("id"), C.words(F.lower("text")).alias("w")).select("id", N._hashes("w", 5).alias("runs"))
    open_rows = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("class_id"))
    pairs = N.across_classes(runs, open_rows, 0.8)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(3 * i, 3 * i + 1) for i in range(0, 60, 4)}


def test_prefixes_lose_no_link(spark):
    """Random weighted sets, the unshared runs first: every pair at the threshold is among the candidates."""
    rng = np.random.default_rng(8)
    sets = {}
    for i in range(40):
        base = rng.integers(0, 10**6, 30).tolist() * 2
        for j in range(4):
            sets[4 * i + j] = sorted(base + rng.integers(0, 10**6, int(rng.integers(0, 9))).tolist() + base[: int(rng.integers(0, 12))])
    rows = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in sets.items()], "id long, runs array<long>")
    found = {(r["a"], r["b"]) for r in N.across_classes(rows, rows.select("id", F.col("id").alias("class_id")), 0.8).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and a // 4 == b // 4 and brute(Counter(sets[a]), Counter(sets[b])) >= 0.8}
    assert want and want <= found


def test_differences_from_a_leader_lose_no_link(spark):
    """Edited copies of one text: what differs from it rules out many pairs, and none that reaches the threshold."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**62, 140).tolist()
    sets = {0: sorted(base + base[:9])}
    for i in range(1, 90):
        own = [v for v in base + base[: int(rng.integers(0, 12))] if rng.random() > rng.choice([0.02, 0.08, 0.14])]
        sets[i] = sorted(own + rng.integers(0, 2**62, int(rng.integers(0, 25))).tolist() + (sets[i - 1][:30] if i % 7 == 0 else []))
    texts = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in sets.items()], "id long, runs array<long>")
    pairs = spark.createDataFrame([(0, i) for i in sets if i], "a long, b long")
    known = N.references(N._scored(pairs, texts, differing=True))
    row = {r["id"]: r for r in known.collect()}
    assert all(row[i]["apart"] == len(set(sets[0]) ^ set(sets[i])) and row[i]["n"] == len(sets[i]) for i in row)
    rows = texts.select("id", F.col("id").alias("class_id"))
    counts = {i: Counter(r) for i, r in sets.items()}
    want = {(a, b) for a in sets for b in sets if a < b and brute(counts[a], counts[b]) >= 0.8}
    loose = {(r["a"], r["b"]) for r in N.across_classes(texts, rows, 0.8).collect()}
    tight = {(r["a"], r["b"]) for r in N.across_classes(texts, rows, 0.8, known).collect()}
    assert want and want <= tight and len(tight) < 0.7 * len(loose)
