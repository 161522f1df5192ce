"""The trees of BPE: every new word goes through one, short or long, and a text is coded once."""

import json
import random

import public_tokenizers
import pyarrow as pa
from lexmill.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_every_word_of_two_symbols_goes_through_a_tree():
    rng, own, lib = random.Random(4), bpe.WordBpe(json.load(open(PATH, encoding="utf-8"))), Tokenizer.from_file(PATH)
    words = {"".join(rng.choice("abcdeéß日") for _ in range(rng.choice((2, 3, 7, 12, 40, 70, 300)))) for _ in range(600)}
    text = " ".join(sorted(words))
    assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert own.trees == len(words)
    own.encode(text)
    assert own.trees == len(words)


def test_pieces_are_given_up_and_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "RECENT", 5)
    own, lib = bpe.WordBpe(json.load(open(PATH, encoding="utf-8"))), Tokenizer.from_file(PATH)
    texts = [f"word{i % 7} other{i % 3}, <|endoftext|>x{i}\x1cy a b c d e f\x85g" for i in range(30)] + ["", " "]
    coded = [c for at in range(0, len(texts), 2) for c in own.code(texts[at : at + 2])]
    for text, (ids, decoded) in zip(texts, coded, strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert bpe.np.frombuffer(ids, bpe.np.int32).tolist() == want and decoded == lib.decode(want, skip_special_tokens=False)
    assert len(own.pieces) < 40


def test_plan_codes_each_text_once(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    coded = bpe.encode_documents(docs, PATH)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("code(text") == 1
    assert {r.doc_id: (len(r.ids), r.decoded) for r in coded.collect()} == {1: (2, "one</w> two</w>"), 2: (0, "")}
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_results_leave_a_worker_some_texts_at_a_time(spark):
    spec = bpe.load_tokenizer(spark, PATH)
    texts = [None if i % 50 == 0 else f"text {i} of them" for i in range(2500)]
    batch = pa.record_batch([pa.array([f"k{i}" for i in range(2500)]), pa.array(texts)], ["doc_id", "text"])
    out = list(bpe._coded_batches(spec)(iter([batch])))
    assert [b.num_rows for b in out] == [1000, 1000, 500]
    rows = pa.Table.from_batches(out).to_pylist()
    model = bpe._of(spec)
    assert [r["doc_id"] for r in rows] == batch.column(0).to_pylist()
    assert all(r["ids"] == model.encode(t or "") for r, t in zip(rows, texts, strict=True))
    df = spark.createDataFrame([(1, "One two"), (None, None), (1, "é")], "doc_id long, text string")
    both = [f(df, PATH) for f in (bpe.encode_documents, bpe.encode_sliced)]
    assert both[0].dtypes == both[1].dtypes and sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))
    assert bpe.encode_sliced(df.limit(0), PATH).count() == 0
