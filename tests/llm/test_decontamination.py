from collections import Counter

import duckdb
from fixtures import odd_documents, prose, words

from tallyglass.llm import decontamination as D
from tallyglass.llm.queries import OP1_SQL


def similarity(a, b):
    a, b = (Counter(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))) for x in (a, b))
    return sum((a & b).values()) / sum((a | b).values())


def best(text, item):
    w, v = words((text or "").lower()), words((item or "").lower())
    starts = range(max(1, len(w) - len(v) + 1)) if w and v else ()
    return max((similarity(w[i : i + len(v)], v) for i in starts), default=0.0)


def test_leaks_match_brute_force_over_all_windows(spark):
    items = {i: prose(50 + i, 20 + 4 * i) for i in range(5)} | {5: None, 6: "", 7: "one two three"}
    v = words(items[2])
    texts = {
        0: prose(1, 80), 1: prose(1, 40) + " " + items[0] + " " + prose(2, 40), 2: prose(3, 40) + " " + items[1].upper() + " tail words",
        3: "x " + " ".join(v[:-1]) + " other end", 4: " ".join(v[:14] + ["new"] + v[14:]), 5: " ".join(v[: len(v) // 2]), 6: items[3] + "\n" + items[4],
        7: None, 8: "", 9: "one two three", 10: "well one two three four", 11: " ".join(v[1:]), 12: items[0] + " " + items[0],
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.find_leaks(docs, bench).collect()}
    want = {(d, i): s for d, t in texts.items() for i, x in items.items() if (s := best(t, x)) >= 0.8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {(1, 0), (2, 1), (6, 3), (6, 4), (12, 0), (9, 7)} <= got.keys()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    passage = " ".join(words(prose(3, 150))[20:60])
    bench = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (2, None)], "item_id long, text string")
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12]
    assert D.drop_leaks(docs, bench.limit(0)).count() == docs.count() and D.find_leaks(docs.limit(0), bench).count() == 0


def test_cut_items_of_any_fingerprint_are_found(spark):
    items = {i: prose(100 + i, 24 + i % 30) for i in range(60)}
    texts = {}
    for i, t in items.items():
        v = words(t)
        n = len(v) // 10
        texts |= {4 * i: " ".join(v[n:] + ["filler"] * n), 4 * i + 1: " ".join(["filler"] * n + v[:-n]), 4 * i + 2: " ".join(v[n:]), 4 * i + 3: " ".join(["filler"] * n + v[n:])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in D.find_leaks(docs, bench).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(texts.items()))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(items.items()))
    want = {(d, i): s for d, i, _, s in con.execute(OP1_SQL).fetchall()}
    assert got.keys() == want.keys() and all(abs(got[k]["similarity"] - want[k]) < 1e-9 for k in want)
    assert max(r["distance"] for r in got.values()) > 22
