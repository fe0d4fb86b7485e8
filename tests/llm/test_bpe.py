import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from narratum.llm import bpe

NAME = "byte_bpe_50k.json"
ODD = ["", " ", "  a", "a  b", "a \n b", "x\n\ny ", "tabs\t\tand  ", "don't we'll I'm 'S", "naïve café déjà", "日本語 テキスト", "a<|endoftext|>b", "<|endoftext|>", "\x1c x \x1d", "\x85 a\x85b", "1234 5x6", "!!! ??? ...", "a b  c", "👍🏽 ok", "é x", "\x00\x01", "  z"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def test_codec_matches_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab'sté \n1!Ω\t") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice(["th", "er", "ing", "tion", "an", " ", " ", "ä", "Lo", "-", "\n"]) for _ in range(rng.randrange(80))) for _ in range(1500)]
    codec = bpe.Codec(public_tokenizers.path(NAME))
    for text, packed in zip(texts, codec.encode(texts)):
        ids = [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)]
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_digests(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(98, None, "x"), (1, "  a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs).collect())) == sorted(want)
    assert bpe.digests(docs.limit(0)).count() == 0


def test_decode_inverts_encode(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    assert all(r.text == r.decoded for r in bpe.decode(bpe.encode(docs)).collect())
