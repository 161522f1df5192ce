"""Near-dedup where bands and leaders are dealt over several tasks and blocks are bounded by their shingles."""

import random

import pytest
from lexmill.llm import near_dedup

from test_operators import components, docs_of, word_shingles


@pytest.mark.parametrize("light", [1, 4])
def test_salted_joins_match_brute_force(spark, monkeypatch, light):
    monkeypatch.setattr(near_dedup, "LIGHT", light)
    monkeypatch.setattr(near_dedup, "SALT", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 150)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):  # one large group whose members differ by more and more words
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(30)) for _ in range(10)] + [texts[0], texts[0], "", None]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(spark, texts), width=3, percent=70).collect()}
    sets = {i: word_shingles(t, 3) for i, t in enumerate(texts)}
    want = components(sets, 70)
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
