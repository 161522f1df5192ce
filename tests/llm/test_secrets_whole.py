"""Secrets next to a sign of equality, and of digits or letters of one case alone."""

import random

from lexmill.llm import secrets


def test_values_after_equality_and_tokens_of_one_case(spark):
    key, rng = "Xk29dPq2ZxW7vT4mN1cR9sB5yH3gL6fQ0", random.Random(5)
    low, digits = ("".join(rng.choice(chars) for _ in range(60)) for chars in ("abcdefghijklmnopqrstuvwxyz", "0123456789"))
    padded = "kJ8dPq2ZxW7vT4mN1cR9sB5yH3gL6fQ0aa=="
    prose = "the house on the hill was there when the other men went to the sea and then they rested near a tree " * 40
    texts = [f"DB_CREDS={key} end", f"AWS_KEY={key}", f"x {low} y", f"x {low.upper()} y", f"x {padded} y", prose]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in secrets.scan_secrets(df).collect()}
    assert got == {0: [(9, 9 + len(key))], 1: [(8, 8 + len(key))], 2: [(2, 62)], 3: [(2, 62)], 4: [(2, 2 + len(padded))], 5: []}
    model = {c: 1 + prose.count(c) for c in map(chr, range(128))}
    assert [c[:2] for c in secrets.candidates(f"x {digits} y", model)] == [(2, 62)]
