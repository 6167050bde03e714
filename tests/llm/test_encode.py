import os
import random

import pytest

from caddis.llm.encode import TOKENIZERS, encode_texts, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files")
SCHEMA = "doc_id bigint, text string, id int, ids string"


def texts():
    rng = random.Random(8)
    pieces = ["the", " dog", "  ", "\n\n", "ab", "aaaa", " 2024", "'ll", "I'LL", "é", "你好世界", "🎉", "𝔸", " ", "\t", ".", "!?", "-", "ſ", "ß", "​", "<|endoftext|>", "\x1c", "½", "ا"]
    out = ["", " ", "a", "aaaaaaa", " aaa aaaa", "<|endoftext|>", "x" * 60_000, "ha" * 20_000, "\x1c\x1d x  y  "]
    return out + ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)]


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    data = [(i, x, 0, "") for i, x in enumerate(texts())]
    got = {r["doc_id"]: r["ids"] for r in encode_texts(spark.createDataFrame(data, SCHEMA)).collect()}
    for i, x, *_ in data:
        assert got[i] == t.encode(x, add_special_tokens=False).ids, x[:80]


def test_null_empty_repeated_and_counts(spark, rows):
    df = spark.createDataFrame([(1, None, 0, ""), (2, "", 0, ""), (3, "a b", 0, ""), (3, "a b", 0, ""), (None, "a", 0, "")], SCHEMA)
    assert rows(encode_texts(df)) == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275]), (None, [64])]
    assert rows(token_counts(df)) == [(1, 0), (2, 0), (3, 2), (3, 2), (None, 1)]
    assert encode_texts(df.limit(0)).count() == 0
