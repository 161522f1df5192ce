"""Dedup over candidates against the comparison with all kept themes."""

import random

import pytest

from lexmill.operators.similarity import _Kept, dedup_themes, equivalent

SCHEMA = "case_id long, idx long, subject string, text string, tokens array<string>, obstacles array<string>, completeness double"


def rows_of(n, seed):
    rng = random.Random(seed)
    words = "responsabilidade civil contrato dano moral juros prova recurso multa banco consumidor prazo preparo honorarios".split()
    base = [[rng.choice(words) for _ in range(rng.randint(1, 7))] for _ in range(8)]
    out = []
    for i in range(n):
        s = list(rng.choice(base))
        if rng.random() < 0.6:
            s[rng.randrange(len(s))] = rng.choice(words)
        subject = " ".join(s)
        if rng.random() < 0.4:
            at = rng.randrange(len(subject))
            subject = subject[:at] + rng.choice("abx ") + subject[at + 1 :]
        body = s + [rng.choice(words) for _ in range(rng.randint(0, 8))]
        subject, tokens = rng.choice([subject] * 8 + ["", None, "ab", "abc"]), rng.choice([list(set(body))] * 9 + [None, []])
        out.append((rng.choice([1, 1, 2, 3]), i, subject, rng.choice([" ".join(body)] * 9 + [None]), tokens, rng.choice([None, [], ["Súmula 7"], ["7", "83"]]), rng.choice([None, 1.0, 2.0, 4.5, 7.0])))
    return out


def plain(rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kept = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        row = dict(zip(names, r, strict=True))
        row |= {"subject": row["subject"] or "", "text": row["text"] or "", "tokens": row["tokens"] or [], "obstacles": row["obstacles"] or [], "completeness": row["completeness"] or 0}
        own = kept.setdefault(row["case_id"], [])
        at = next((i for i, k in enumerate(own) if equivalent(row, k)), None)
        if at is None:
            own.append(row)
        elif row["completeness"] > own[at]["completeness"]:
            own[at] = row
    return sorted((c, k["idx"]) for c, own in kept.items() for k in own)


@pytest.mark.parametrize("seed", range(6))
def test_candidates_leave_no_equal_theme_out(spark, seed):
    rows = rows_of(220, seed)
    got = sorted((r.case_id, r.idx) for r in dedup_themes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain(rows)
    assert len(got) < len(rows)


def test_a_theme_meets_few_of_many_kept():
    rng, kept = random.Random(1), _Kept()
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40))
    for i in range(3000):
        kept.put({"subject": name(), "tokens": [f"t{i}", f"u{i % 50}"], "text": "", "obstacles": [], "completeness": 0}, i)
    same = kept.rows[77]["subject"]
    assert kept.candidates({"subject": same[:39] + "!", "tokens": ["t5", "u5"], "text": "", "obstacles": []}) == [5, 77]
    assert kept.candidates({"subject": name(), "tokens": ["zz"], "text": "", "obstacles": []}) == []
    kept.put({"subject": name(), "tokens": ["new"], "text": "", "obstacles": [], "completeness": 1}, 77)
    assert kept.candidates({"subject": same, "tokens": ["zz"], "text": "", "obstacles": []}) == []


def test_no_themes(spark):
    assert dedup_themes(spark.createDataFrame([], SCHEMA)).count() == 0
