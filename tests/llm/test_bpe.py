import os
import random

import pytest

from epochloom.llm.bpe import VOCABULARY, count_tokens, encode_documents, encoder

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")

TEXTS = [
    None, "", " ", "\n\n  x  ", "Hello world's  end", "Привет, мир!", "東京は晴れ。ハロー", "🧪👍🏽 é", "<|endoftext|> x", "a" * 3000, "ab" * 900, "　 \x85\x1c\x1f y", "x​y", "1234567 3.14",
    "don't we'll I'M", "tab\t\tend ", "é" * 400, "﻿bom", "mixed漢字kanaかな", "  leading",
]


def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def test_equals_the_public_library():
    t, e = reference(), encoder(VOCABULARY)
    rng = random.Random(2)
    noise = ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x3000, 0x30FF), rng.randint(0x400, 0x4FF), 32, 32])) for _ in range(60)) for _ in range(300)]
    for text in [x for x in TEXTS if x] + noise:
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_short_and_long_merges_agree():
    e, rng = encoder(VOCABULARY), random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("abcdeéя東 ") for _ in range(rng.randint(1, 200))).encode()
        assert e.merge_short(word) == e.merge_long(word)
        assert b"".join(k for t in e.merge_long(word) for k in [next(b for b, r in e.ranks.items() if r == t)]) == word if len(word) < 6 else True


def test_documents(spark):
    rows = [(i, t, "x", [1]) for i, t in enumerate(TEXTS)] + [(0, "again", "x", [1]), (None, "no id", "x", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, ids array<int>")
    out = encode_documents(df).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r["ids"] for r in out if r["doc_id"] not in (0, None)}
    assert by[1] == [] and by[4] == encoder(VOCABULARY).encode(TEXTS[4])
    assert sorted(len(r["ids"]) for r in out if r["doc_id"] == 0) == [0, 1]
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, ["doc_id"]).collect()}
    assert counts[1] == 0 and counts[9] == len(by[9])
    assert encode_documents(df.limit(0)).count() == 0
