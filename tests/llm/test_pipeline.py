"""The pipeline against a brute-force version of its decisions."""

import random

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from glossia.llm import bpe  # noqa: E402


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda lang, n: " ".join("".join(rng.choice("thegn" if lang == "en" else "éauxl") for _ in range(6)) for _ in range(n))
    item = prose("en", 30)
    texts = [prose("en" if i % 2 else "fr", 120) for i in range(60)]
    texts += [texts[3], texts[3] + " x", None, "", "12 34 !!", f"{prose('en', 40)} {item} tail", texts[5] + " mail a.b@c.org now", prose("en", 80) + " mail a.b@c.org now"]
    docs = [(i, t, "en" if i % 2 else "fr", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert set(got) == set(range(68)) - {60, 61, 62, 63, 64, 65, 66}  # copies, near copies, no language, a leak
    one = bpe.encoder(bpe.default_vocabulary())
    for i, r in got.items():
        text = one.decode(np.frombuffer(r.ids, "<u2")).decode()
        assert text == texts[i].replace("a.b@c.org", "[EMAIL]")
        assert r.n_tokens * 2 == len(r.ids)


def test_stages_keep_the_columns():
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "personal_data", "bpe_encoding"]
