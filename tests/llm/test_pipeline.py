"""The pipeline's stages on a small table."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    prose = [" ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for w in "the quick brown fox jumps over a lazy dog and runs away from that old house".split()) for i in range(40)]
    leak = "this passage of the benchmark stands in a document and has to be found there by the stage"
    texts = [*prose, prose[3], prose[4] + " tail", "12345 !!", None, f"begin {leak} end", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == corpus_pipeline.COLUMNS, name
    ids = sorted(r.doc_id for r in seen.collect())
    assert ids == list(range(40))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == ids and out.where(F.size("ids") == 0).count() == 0


def test_language_gate(spark, tmp_path):
    rng = random.Random(7)
    parts = {"en": "the tion and er ing ha wa th re st on of", "fr": "le ment eau oi que ré ou et dans èn aux le", "de": "der ung sch ein ch heit und en st ge ber ie"}

    def prose(lang, words):
        own = parts[lang].split()
        return " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 3))) for _ in range(words))

    labelled = [(lang, prose(lang, rng.choice([3, 8, 30, 120, 300]))) for lang in parts for _ in range(150)]
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(rng.choice([20, 60, 200]))) for _ in range(100)]
    unlearned = ["Tämä on suomenkielinen lause, joka kertoo vanhasta talosta ja sen asukkaista metsän reunalla, missä lapset leikkivät koko pitkän kesän",
                 "Ini adalah kalimat bahasa Indonesia tentang rumah tua dan penghuninya di tepi hutan yang gelap sekali"]
    unlabelled = [prose(lang, n) for lang in parts for n in (20, 100) for _ in range(10)]
    rows = [(i, t, lang) for i, (lang, t) in enumerate([*labelled, *((None, t) for t in [*unlabelled, *noise, *unlearned, None, "12 34 !"])])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    n, u = len(labelled), len(unlabelled)
    assert len([i for i in range(n) if i in kept]) > 0.99 * n
    assert all(n + i in kept for i in range(u))
    assert len([i for i in range(n + u, len(rows)) if i in kept]) < 0.05 * (len(rows) - n - u)
    assert corpus_pipeline.language(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.language(spark, docs.where("lang is null"), str(tmp_path)).count() == 0


def test_decontaminate_holds_long_runs(spark, tmp_path):
    # A run of names or numbers ended the executor in this stage.
    leak = "this passage of the benchmark stands in a document and has to be found there by the stage"
    runs = [" ".join(["Alpha Beta"] * 20_000), "12," * 40_000 + "12"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*runs, *(f"{leak} {r}" for r in runs)])], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()) == [0, 1]
