import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from narratum.llm import toxicity

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def tables(spark, folder):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice(["th", "er", "an", "in", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    texts = [say(rng.randrange(60, 200)) for _ in range(150)]
    for k in range(0, 150, 6):
        texts[k] = " ".join(w + (" moron" if rng.random() < 0.15 else "") for w in texts[k].split()) + " moron"
    item, passage = say(40), say(70)
    texts[1] += " " + item
    texts[2] += " " + passage
    texts[3] = passage + "  " + texts[3]
    texts += [texts[4], texts[5] + " ", "", None, "", say(20_000)]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int("moron" in texts[k])) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, item, passage


def test_stages_and_run(spark, tmp_path):
    texts, item, passage = tables(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append({r.doc_id: r for r in docs.collect()})
        assert k == 4 or docs.columns == names
    toxic = {k for k, t in enumerate(texts) if t and "moron" in t}
    assert len(toxic & set(seen[0])) <= 1 and len(set(range(len(texts))) - toxic - set(seen[0])) <= 2
    assert not {150, 151, 153, 154} & set(seen[1]) and {4, 5, 152} <= set(seen[1])
    assert seen[2].keys() == seen[1].keys() and passage in seen[2][2].text and passage not in seen[2][3].text and seen[2][3].n_chars == len(seen[2][3].text)
    assert set(seen[2]) - set(seen[3]) == {1}
    for i, r in seen[4].items():
        assert r.round_trip and list(r.ids) == LIBRARY.encode(seen[3][i].text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen[4])
    assert toxicity.THRESHOLD == 0.3


def test_stages_on_odd_tables(spark, tmp_path):
    """Columns of any name, repeated rows, null ids and texts, and no rows at all."""
    tables(spark, tmp_path)
    own = "doc_id long, text string, row string, key long, score double, spans int, h long, th int"
    rows = [(1, "one two three four five six", "a", 1, 0.1, 1, 1, 1), (1, "one two three four five six", "b", 2, 0.2, 2, 2, 2), (2, None, "c", 3, 0.3, 3, 3, 3), (None, "alone with no id at all", "d", 4, 0.4, 4, 4, 4), (None, "", None, None, None, None, None, None)]
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, own)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/odd{k}-{name}")
            out = spark.read.parquet(f"{tmp_path}/odd{k}-{name}")
            if name != "bpe_encoding":
                assert out.columns == docs.columns
                docs = out
        assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in out.collect()) == ([(0, True), (1, True), (2, False)] if data else [])
