from collections import Counter

from fixtures import odd_documents, odd_rows, prose, words

from tallyglass.llm import quality_rules as Q


def repeats(text):
    w = words(text)
    n = Counter(zip(w, w[1:], w[2:]))
    return len({p for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})


def test_measures_match_plain_python(spark):
    texts = [t for _, t in odd_rows()] + ["a b c a b c", "a a a a a", "x y z\nx y z\n\nq", "a b a b a b", prose(5, 90) + "\n" + prose(5, 90)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.verdicts(rows).collect():
        t = r["text"] or ""
        lines = [x for x in t.split("\n") if words(x)]
        assert r["n_words"] == len(words(t)) and r["word_chars"] == sum(map(len, words(t)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeats(t)
        assert r["base_failed"] == (len(words(t)) < 50 or 100 * repeats(t) > 50 * len(words(t)))


def test_lines_fail_by_their_rules(spark):
    good = prose(6, 120)
    cases = {
        good: (0, 0, 0, 0), good + "\nno end of a sentence here": (1, 0, 0, 0), good + "\nhome | news | sport | more": (0, 1, 0, 0),
        good + "\nAll rights reserved, click here.": (0, 0, 1, 0), good + "\nTHIS IS A SHOUTED LINE!!": (0, 0, 0, 1),
        good + "\nab*** cd### ef$$$ gh%%%": (0, 0, 0, 1),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in Q.verdicts(rows).collect():
        got = tuple(r[c] for c in ("lines_punctuation", "lines_navigation", "lines_boilerplate", "lines_noise"))
        assert got == cases[r["text"]] and r["kept"]


def test_clean_keeps_columns_and_whole_texts(spark):
    docs = odd_documents(spark)
    out = Q.clean(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 6, 7, 8, 9, 9]
    source = dict(odd_rows())
    assert all(r["text"] == source[r["doc_id"]] and r["kept"] == 7 and r["n_chars"] == len(r["text"]) for r in rows)
    dirty = prose(7, 100) + "\nhome | news | sport | more\n" + prose(8, 20)
    row = Q.clean(odd_documents(spark, [(1, dirty)])).first()
    assert row["text"] == prose(7, 100) + "\n" + prose(8, 20) and row["n_chars"] == len(row["text"])
    assert Q.clean(docs.limit(0)).count() == 0
    lost = "\n".join(["home | news | sport | more"] * 2 + [f"no end number {i} of a line that runs on" for i in range(20)] + [prose(9, 60)])
    assert Q.verdicts(odd_documents(spark, [(1, lost)]).select("doc_id", "text")).first()["kept"] is False


def test_a_phrase_in_a_long_line_does_not_fail_it(spark):
    long_line = " ".join(prose(10, 150).split())
    inner = ["a sign in the window", "a sign indicating rain", "he read moreover", "a log in the river", "we read more of it"]
    texts = [long_line + f" {x}, as they said." for x in inner]
    rows = Q.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in rows) == sorted(texts)
    words_only = ["A sign indicating.", "Readers read moreover."]
    furniture = ["All rights reserved, click here.", "Sign in | Log in to see.", "Read more: our privacy policy.", "© 2026 Some Name Ltd. All rights reserved."]
    mixed = "\n".join([long_line, *words_only, *furniture])
    row = Q.clean(spark.createDataFrame([(1, mixed)], "doc_id long, text string")).first()
    assert row["text"] == "\n".join([long_line, *words_only])
