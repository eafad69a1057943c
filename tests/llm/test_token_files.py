import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from fixtures import odd_documents, odd_rows
from tokenizers import Tokenizer

from tallyglass.llm import token_files as T
from tallyglass.session import scratch_dir

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for k in range(120):
        n = int(rng.integers(0, 700))
        values = rng.integers(0, 1 << int(rng.integers(1, 63)), n, dtype=np.uint64)
        if k % 3 == 0:
            values = np.where(rng.random(n) < 0.05, values * np.uint64(2) + np.uint64(1 << 63), np.uint64(0)).astype(np.uint64)
        if k % 4 == 0:
            values[10:400] = 0
        assert (T.decode(T.encode(values)) == values).all()
    assert len(T.encode(np.zeros(480, np.uint64))) == 2 and len(T.encode(np.ones(60, np.uint64))) == 1
    assert len(T.encode(np.array([1 << 63], np.uint64))) == 2


def test_word_encoder_equals_the_tokenizer():
    plain, encoder = Tokenizer.from_file(FILE), T.WordEncoder(FILE, most=50)
    odd = ["a\x1cb c\xa0d  'S dont's é ́x <|endoftext|> x<|startoftext|>y\x85z", "", "ΣΑΣ\x0bİ ﬁ", "Don'T É ok", "\xa0", "x y　z", " ́a", "A<|ENDOFTEXT|>"]
    for text in odd + [t for _, t in odd_rows() if t]:
        assert encoder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_column_of_latin_and_other_texts_equals_the_tokenizer():
    plain, encoder = Tokenizer.from_file(FILE), T.WordEncoder(FILE, most=300)
    rng = random.Random(5)
    latin = [chr(c) for c in range(256)] + ["'s", "'LL", "don't", "  ", "\n", "a1", "É"]
    other = ["中文", "T\u0308", "\u0301", "İ", "Σ", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "\u3000", "٣", "😀"]
    for pool in (latin, [c for c in latin if c not in T.CONTROLS], latin + other * 9):
        texts = ["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(400)] + ["", None]
        column = pa.array(["left out", *texts]).slice(1)
        got = [encoder.encode_column(column.slice(low, high - low)) for low, high in T.spans(column, 3000)]
        assert len(got) > 2
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert np.concatenate([sizes for _, sizes in got]).tolist() == [len(ids) for ids in want]
        assert np.concatenate([ids for ids, _ in got]).tolist() == [i for ids in want for i in ids]


def test_each_piece_is_encoded_once():
    encoder, asked = T.WordEncoder(FILE), []
    learn = encoder._learn
    encoder._learn = lambda new, tokenizer: (asked.extend(new), learn(new, tokenizer))
    ids, sizes = encoder.encode_column(pa.array(["Word, word. (word)", "WORD; don't word's", "word word, word"]))
    assert sorted(asked) == sorted(["word", ",", ".", "(", ")", ";", "don", "'t", "'s"]) and sizes.tolist() == [7, 6, 4]


def test_files_give_back_all_ids(spark):
    plain = Tokenizer.from_file(FILE)
    docs = odd_documents(spark)
    folder = scratch_dir(spark, "tokens")
    manifest = T.write_tokens(docs, folder, FILE, block=64, file_ids=5000)
    assert manifest.count() > 2
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in T.read_tokens(manifest, folder, group=3).collect()))
    want, start = [], 0
    for key, text in sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((start, key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = scratch_dir(spark, "tokens")
    assert T.read_tokens(T.write_tokens(docs.limit(0), empty, FILE), empty).count() == 0
