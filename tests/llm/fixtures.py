"""Small documents with every odd case, and plain-Python versions of the measures."""

import random
import re

SPACE = r"[^\x20\x09-\x0D]+"
EXTRA = ("kept", "n_words", "bucket", "id", "class_id", "shard", "slot", "epoch", "place", "doc", "text_crc32", "word_count")


def words(text):
    return re.findall(SPACE, text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    names = ["w" + "".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        w = rng.choice(names)
        out.append((w.capitalize() if i % 9 == 0 else w) + ("." if i % 9 == 8 else "") + ("\n" if i % 36 == 35 else " "))
    return "".join(out).strip() + "."


def odd_rows():
    """(doc_id, text): plain, null, empty, blank, short, very long, equal, near, repeated and unnamed rows."""
    base = prose(1, 200)
    near = base.split(" ")
    near[100] = "changed"
    long_text = prose(2, 60_000, 5000)
    return [
        (1, base), (2, None), (3, ""), (4, " \n\t "), (5, "two words"), (6, long_text), (7, base), (8, " ".join(near)), (9, prose(3, 150)),
        (9, prose(3, 150)), (None, prose(4, 120)), (10, "only one line without an end"), (11, "É ß é́   Ω 😀 x."), (12, "two words"),
    ]


def odd_documents(spark, rows=None):
    """The odd rows with the columns of documents and columns of clashing names."""
    data = [(i, t, "en" if (i or 0) % 2 else None, None if i == 5 else f"src{(i or 0) % 4}", len(t or ""), *([7] * len(EXTRA))) for i, t in (odd_rows() if rows is None else rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in EXTRA)
    return spark.createDataFrame(data, schema)
