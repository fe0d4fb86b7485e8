import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from narratum.llm import wavelet


def test_encoder_matches_library():
    rng = random.Random(9)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), wavelet.WordEncoder(path)
    pool = ["a", "B", "th", "ING", "'s", "'LL", "9", "42", "!", "...", "é", "É", "ß", "İ", "Σ", "ς", "ﬁ", "e\u0301", "\u0301", "\xa0", "\x85", "\x1c", "\x7f", "日", "👍", " ", "  ", "\n", "\t", "½", "<|endoftext|>", "<|", "ǅ", "\u200b"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(4000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_matrix_operations():
    rng = random.Random(5)
    for n, top in ((0, 1), (1, 1), (700, 3), (5000, 49000), (1500, 2)):
        flat = np.array([int(rng.random() ** 4 * top) for _ in range(n)], "<u4")
        cut = n // 3
        m = wavelet.WaveletMatrix(wavelet.build([(4, flat[:cut].tobytes()), (None, b""), (9, flat[cut:].tobytes())]))
        assert m.doc_ids == [4, None, 9] and m.lengths.tolist() == [cut, 0, n - cut]
        assert (m.sequence() == flat).all()
        at = np.array([rng.randrange(n) for _ in range(200)] if n else [], np.int64)
        assert (m.access(at) == flat[at]).all()
        for token in [*set(flat[:20].tolist()), 77777]:
            assert m.occurrences(token).tolist() == np.flatnonzero(flat == token).tolist()
            low, high = n // 4, n // 2
            assert m.count(token) == (flat == token).sum() and m.count(token, low, high) == (flat[low:high] == token).sum()


def test_digests(spark, monkeypatch):
    texts = ["Hello, World's end", "", None, "É é ΣΑΣ \x1c!\x1c!", "a<|endoftext|>b <|startoftext|>", "日本語 12345 don't", "long " * 5000, "same", "same"]
    rows = [(k * 7 % 11, t, "x") for k, t in enumerate(texts)] + [(3, "same id", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 50)
    got = wavelet.digests(docs).collect()
    want = {}
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i, *x) for i, xs in want.items() for x in xs)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert wavelet.digests(docs.limit(0)).count() == 0


def test_lookup(spark):
    docs = spark.createDataFrame([(1, "the cat the"), (2, "a the")], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    (the,) = library.encode("the", add_special_tokens=False).ids
    images = wavelet.write(docs)
    assert sorted(map(tuple, wavelet.locate(images, the).collect())) == [(1, 0), (1, 2), (2, 1)]
    assert sum(r.n for r in wavelet.count(images, the).collect()) == 3
