import random

import numpy as np
from fixtures import EXTRA, odd_documents, prose

from tallyglass.llm import toxicity as X

BAD = ["vilegrub", "rotfoul", "scornmuck", "vilespit"]


def corpus(n, seed):
    """Documents of sentences; toxic ones have one or two sentences with a bad word. Returns rows and the bad sentences."""
    rng = random.Random(seed)
    rows, spots = [], {}
    for i in range(n):
        words = prose(1000 + seed, 4000).split()
        sentences = []
        for _ in range(rng.randint(1, 25)):
            low = rng.randrange(3900)
            sentences.append(" ".join(w.strip(".").lower() for w in words[low : low + rng.randint(4, 14)]) + ".")
        toxic = int(i % 6 == 0)
        for _ in range(toxic * rng.randint(1, 2)):
            at = rng.randrange(len(sentences))
            sentences[at] = f"you {rng.choice(BAD)}{rng.choice(['', 's', 'ly'])} " + sentences[at]
            spots.setdefault(i, set()).add(at)
        rows.append((i, rng.choice([" ", "\n"]).join(sentences), toxic))
    return rows, spots


def test_held_out_documents_and_sentences(spark):
    rows, _ = corpus(500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = X.train(docs, labels, X.Settings(features=512))
    fresh, spots = corpus(120, 2)
    other = spark.createDataFrame([(*r[:2], 0.5) for r in fresh], "doc_id long, text string, score double")
    found = {r["doc_id"]: r for r in X.locate(other, model).collect()}
    assert X.score(other, model).columns == ["doc_id", "score", "_score", "n_sentences", "worst_sentence", "n_offending"]
    hit = {k for k, r in found.items() if r["_score"] >= 0.7}
    toxic = {r[0] for r in fresh if r[2]}
    assert len(hit & toxic) >= 0.9 * len(toxic) and len(hit - toxic) <= 2
    for key in hit & toxic:
        bad = [s for s in found[key]["offending"] if s["chance"] >= 0.5]
        raw = fresh[key][1].encode()
        assert all(raw[s["low"] : s["high"]].decode() == s["sentence"] for s in bad)
        named = [s for s in bad if any(b in s["sentence"] for b in BAD)]
        assert len(named) >= 1 and len(bad) - len(named) <= 1


def test_noisy_or_by_hand():
    chances, owner = np.array([0.5, 0.5, 0.1]), np.array([0, 0, 2])
    assert np.allclose(X.noisy_or(chances, owner, 3), [0.75, 0, 0.1])


def test_scores_do_not_depend_on_neighbours(spark):
    rng = np.random.default_rng(3)
    settings = X.Settings(bits=12)
    model = X.Model(np.arange(0, 4096, 3), rng.standard_normal(1366), -3.0, settings.grams, 12)
    docs = odd_documents(spark)
    whole = {(r["doc_id"], r["n_chars"]): (r["score"], r["n_sentences"]) for r in X.score(docs, model).collect()}
    table = model.table()
    for row in docs.collect():
        block = X.Block([X.lowered(row["text"] or "")])
        chances = X.sentence_scores(block, model, table, table != 0)
        alone = X.noisy_or(chances, block.text, 1)[0]
        score, n = whole[(row["doc_id"], row["n_chars"])]
        assert n == len(chances) and abs(score - alone) < 1e-12 and 0 <= score <= 1
    assert whole[(2, 0)] == (0, 0) and whole[(3, 0)] == (0, 0) and whole[(4, 4)] == (0, 0)


def test_features_by_hand():
    block = X.Block([b"you fool! go. on", b"", b"..."])
    assert [bytes(block.data[a:b].astype(np.uint8)).strip() for a, b in zip(block.low, block.high)] == [b"you fool", b"go", b"on"]
    assert block.text.tolist() == [0, 0, 0]
    keep = np.ones(1 << 12, bool)
    sentence, bucket = block.hits((3,), 12, keep)
    again = X.Block([b"filler one.", b"you fool! go. on"])
    other, same = again.hits((3,), 12, keep)
    assert set(bucket[sentence == 0]) == set(same[other == 1])


def test_odd_labels_and_tables(spark):
    docs = odd_documents(spark)
    assert set(EXTRA) <= set(docs.columns)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one_sided = spark.createDataFrame([(1, 0), (None, 1), (9, 0), (9, None), (77, 1), (8, 5)], "doc_id long, toxic int")
    for labels in (none, one_sided):
        scored = X.score(docs, X.train(docs, labels)).collect()
        assert len(scored) == docs.count() and all(r["score"] < 1e-9 for r in scored)
    both = spark.createDataFrame([(1, 0), (9, 1), (9, 0), (12, 1)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in X.score(docs, X.train(docs, both)).collect())
    assert X.score(docs.limit(0), X.train(docs.limit(0), both)).count() == 0
