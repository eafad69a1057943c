import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import odd_documents, odd_rows
from tokenizers import Tokenizer

from tallyglass.llm import alignment as A

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """Rows of the operator by whole-text encoding and a walk over both token lists."""
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    names = A.Tokenizers(FIRST, SECOND)
    met, found = collections.Counter(), []
    for key, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        sides = [[names.a_bytes[i] for i in a], [names.b_bytes[i] for i in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            found.append((key, 0, 0, [], [], ""))
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in sides]
        i = j = 0
        links, groups, mine = [], [], ([], [])
        fresh = [True, True]
        while i < len(a) and j < len(b):
            if fresh[0]:
                mine[0].append(str(a[i]))
            if fresh[1]:
                mine[1].append(str(b[j]))
            links.append((a[i], b[j]))
            fresh = [ends[0][i] <= ends[1][j], ends[1][j] <= ends[0][i]]
            if all(fresh):
                groups.append(",".join(mine[0]) + "|" + ",".join(mine[1]))
                mine = ([], [])
            i, j = i + fresh[0], j + fresh[1]
        met.update(links)
        found.append((key, len(a), len(b), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = {}
    for (_, y), n in met.items():
        top[y] = max(top.get(y, 0), n)
    return [(k, a, b, len(g), len(x), sum(met[p] == top[p[1]] for p in x), sum(met[p] for p in x), d) for k, a, b, g, x, d in found]


ODD = [
    (20, "a  b   c\n\n d\t\te \r\n;\r x"), (21, " lead and trail  "), (22, "x▁y"), (23, "</s><unk><|endoftext|> <0x41>"), (24, "'s don't I'll 漢字 😀é́ ﬁ\x00\x1c　z"),
    (25, "\n"), (26, " "), (27, "\t x"), (28, "word" * 3000), (29, "(((;\r\r\n)))"), (30, "end \n"),
]


def order(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("block", [50, 1 << 23])
def test_equals_brute_force(spark, block):
    docs = odd_documents(spark, odd_rows() + ODD)
    got = A.align(docs, FIRST, SECOND, block=block)
    assert got.columns[: len(NAMES)] == NAMES
    assert sorted((tuple(r)[:8] for r in got.collect()), key=order) == sorted(brute(odd_rows() + ODD), key=order)


def test_empty_and_clashing(spark):
    assert A.align(odd_documents(spark).limit(0), FIRST, SECOND).count() == 0
    blank = A.align(spark.createDataFrame([(1, None), (1, "")], "n_a long, text string"), FIRST, SECOND, key="n_a")
    assert blank.columns[:2] == ["n_a", "_n_a"] and [tuple(r)[1:8] for r in blank.collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_row_products():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, m, k = rng.integers(1, 12, 3)
        dense = [(rng.random(s) < 0.3) * rng.integers(1, 5, s) for s in ((n, m), (m, k))]
        left, right = (A.Csr(np.r_[0, np.cumsum((d > 0).sum(axis=1))], np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in dense)
        out = A.row_products(left, right, rows=3)
        full = np.zeros((n, k), np.int64)
        full[np.repeat(np.arange(n), np.diff(out.starts)), out.columns] = out.values
        assert (full == dense[0] @ dense[1]).all() and (np.diff(out.starts) >= 0).all()
        turned = right.turned()
        assert turned.height == k and turned.starts[-1] == right.starts[-1]
