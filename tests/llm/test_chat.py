import hashlib

from tallyglass.llm import chat as C


def test_fold_replaces_and_appends(spark):
    log = [
        (1, 1, 1, "open", "user", "dra"), (1, 2, 1, "edit", "user", "final"), (1, 3, 2, "open", "assistant", ""), (1, 4, 2, "delta", "assistant", "bad"),
        (1, 5, 2, "regenerate", None, None), (1, 7, 2, "delta", None, "od"), (1, 6, 2, "delta", None, "go"), (1, 8, 1, "delta", "user", "!"), (2, 1, 1, "delta", "user", "only"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message int, kind string, role string, text string")
    got = [tuple(r) for r in C.fold(events).orderBy("conv_id", "seq").collect()]
    assert got == [(1, 1, "user", "final!"), (1, 3, "assistant", "good"), (2, 1, "user", "only")]
    assert C.summarise(C.render(C.fold(events.limit(0)))).count() == 0


def test_summaries_match_plain_python(spark):
    rows = [
        (1, 0, "system", "<|im_end|>\n[x] <<\\ [n"), (1, 1, "user", None), (1, 2, "assistant", "[/INST]</s>\\"), (1, 3, "assistant", ""),
        (2, 0, "user", "x" * 20_000), (2, 1, "assistant", "é😀<" * 5000), (3, 1, "a\nb[n", "tie 2"), (3, 1, "a\nb[n", "tie 1"), (3, 1, "user", "q"), (3, 1, "user", "q"),
        (None, 0, None, "nobody"), (4, None, "assistant", "null turn"),
    ]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, message long")
    output = C.render(C.fold(C.as_events(frame)))
    got = {r["conv_id"]: r for r in C.summarise(output).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        loss = "".join(text or "" for _, _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for r in output.collect():
        inner = r["formatted"][len(C.START) : -len(C.END)]
        assert C.START not in inner and C.END not in inner and "</s>" not in inner and "[/INST]" not in inner
