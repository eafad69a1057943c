import hashlib
from collections import defaultdict

from fixtures import odd_documents, prose, words

from tallyglass.llm import mixing as M


def water(above, nodes):
    """Budgets of siblings {name: (weight, supply)} by repeated redistribution."""
    left, out = dict(nodes), {}
    while left:
        share = above / sum(w for w, _ in left.values())
        full = [k for k, (w, s) in left.items() if s <= share * w + 1e-6]
        if not full:
            return out | {k: int(share * w + 1e-6) for k, (w, _) in left.items()}
        for k in full:
            out[k] = left.pop(k)[1]
            above -= out[k]
    return out


def brute(rows, plan):
    leaves = defaultdict(list)
    for i, t, lang, source in rows:
        leaves[(lang or M.NONE, source or M.NONE)].append((i, t, len(words(t)) + 1))
    supply = {k: sum(n for _, _, n in v) * plan.epochs for k, v in leaves.items()}
    weight = lambda level, value: plan.weights.get(level, {}).get(value, 1.0)
    total = sum(supply.values()) // plan.epochs
    langs = water(min(int(total * plan.share + 1e-6), sum(supply.values())), {a: (weight("lang", a), sum(s for (b, _), s in supply.items() if a == b)) for a, _ in supply})
    out = []
    for lang, budget in langs.items():
        for source, part in water(budget, {b: (weight("source", b), s) for (a, b), s in supply.items() if a == lang}).items():
            docs = leaves[(lang, source)]
            full, rest = divmod(part, sum(n for _, _, n in docs))
            out += [(i, e) for e in range(full) for i, _, _ in docs]
            key = lambda d: (hashlib.md5(f"{plan.seed}:{full}{'' if d[0] is None else f':{d[0]}'}".encode()).hexdigest(), d[1] is not None, d[1] or "")
            for i, _, n in sorted(docs, key=key):
                rest -= n
                if rest < 0:
                    break
                out.append((i, full))
    return sorted(out, key=str)


def test_selection_matches_redistribution(spark):
    rows = [(i, prose(i, 5 + i % 40, 50), "en de fr".split()[i % 7 % 3], f"src{i % 5}") for i in range(150)] + [(900, None, None, None), (901, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for share, weights in ((0.5, {}), (1.0, {"lang": {"fr": 9.0}, "source": {"src1": 5.0}}), (5.0, {}), (0.3, {"lang": {"en": 0.1}})):
        plan = M.Plan(("lang", "source"), weights, share=share, epochs=2, digits=1)
        got = sorted(((r["i"], r["epoch"]) for r in M.select(docs, plan).selectExpr("doc.doc_id i", "epoch").collect()), key=str)
        assert got == brute(rows, plan)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = M.mixed(docs, M.Plan(("lang", "source"), share=2.0, epochs=2))
    assert out.columns == docs.columns and out.count() == 2 * docs.count()
    assert M.mixed(docs.limit(0), M.Plan(("lang", "source"))).count() == 0
