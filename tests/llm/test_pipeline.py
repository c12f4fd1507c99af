"""The pipeline over a small corpus whose outcome is known."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from fieldglass.llm import pii


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    stock = {"aa": [f"ba{a}{b}o" for a in "nmrt" for b in "aeiou"], "bb": [f"kr{a}{b}tz" for a in "aiou" for b in "nlrm"]}
    text = lambda lang, n: " ".join(rng.choice(stock[lang]) + str(rng.randrange(10)) * (rng.random() < 0.01) for _ in range(n))
    rows = [(i, text(lang, 120) + f" z{i}", lang) for i, lang in enumerate(rng.choice(["aa", "bb"]) for _ in range(150))]
    item = text("aa", 40)
    planted = [
        (1000, rows[3][1], rows[3][2]), (1001, rows[4][1] + " end", rows[4][2]), (1002, "lead " + item + " tail", "aa"), (1003, text("bb", 60) + " Krantz.9@mail3.example.com and +1 (614) 555-8001", "bb"),
        (1004, None, None), (1005, "", "aa"), (1006, "Привет как дела сегодня и завтра тоже", None), (1007, "12 %%", "bb"),
    ]
    docs = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows + planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, current, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        current = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert current.columns == docs.columns
        seen.append({r.doc_id: r for r in current.collect()})
    whole = {i for i, _, _ in rows}
    assert set(seen[0]) == whole | {1000, 1001, 1002, 1003}
    assert set(seen[1]) == whole | {1002, 1003}
    assert set(seen[2]) == set(seen[3]) == whole | {1003}
    changed = {i for i in seen[3] if seen[3][i].text != seen[2][i].text}
    assert changed == {1003} and seen[3][1003].text == pii.replaced(seen[2][1003].text)[0] and seen[3][1003].n_chars == len(seen[3][1003].text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    totals = {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in seen[3].items()}
    got: dict = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == totals
    assert np.unique([(r.sequence_id, r.offset) for r in packed], axis=0).shape[0] == len(packed)


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
