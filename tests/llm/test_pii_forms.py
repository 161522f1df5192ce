"""Forms of personal data at their limits, and surrogates against what they must keep."""

import re
import zlib

import pytest
from lexmill.llm import pii

SCHEMA = "doc_id long, text string"


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r.doc_id: (r.text, r.pii_count) for r in pii.replace_pii(df, key).collect()}


def luhn(number):
    d = [int(c) for c in number if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_nothing_of_an_entity_is_left(spark):
    local = "x" * 300
    got = replaced(spark, [f"a {local}@mail.com b", "a x@a.b.c.d.e.f.g.h b", "a 3782 822463 10005 b", "a Dr. Smith b", "a Mr O'Brien and Mr McDonald b", "Jennifer Brown was here",
                           "Maria Lopez spoke. Then Lopez left, Lopezes stay.", "Mr. JOHN SMITH-JONES b", "word " * 100_000 + "q@w.example"])
    assert "xxx" not in got[0][0] and re.fullmatch(r"a \S+@\w+\.example b", got[0][0])
    assert re.fullmatch(r"a \S@\w+\.example b", got[1][0])
    assert re.fullmatch(r"a \d{4} \d{6} \d{5} b", got[2][0]) and "3782" not in got[2][0] and luhn(got[2][0])
    assert got[3][0].startswith("a Dr. ") and "Smith" not in got[3][0]
    assert "Brien" not in got[4][0] and "Donald" not in got[4][0] and got[4][1] == 2
    assert "Brown" not in got[5][0] and got[5][0].split()[0] in pii.GIVEN["f", "latin"]
    family = got[6][0].split()[1]
    assert re.fullmatch(rf"\w+ {family} spoke\. Then {family} left, Lopezes stay\.", got[6][0]) and got[6][1] == 2
    assert "SMITH" not in got[7][0] and got[8][1] == 1 and "q@w" not in got[8][0]


def test_numbers_that_are_no_entity_stay(spark):
    texts = ["4845168114407328 has a wrong check digit", "at 2024-01-31 10:30 and 31.01.2024 10:30:05", "12 34", None, ""]
    assert replaced(spark, texts) == {i: (t, 0) for i, t in enumerate(texts)}


def test_one_number_in_several_forms(spark):
    got = replaced(spark, ["+12175557713", "+1 217-555-7713", "+1 (217) 555-7713", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"])
    digits = {re.sub(r"\D", "", got[i][0]) for i in range(3)}
    assert len(digits) == 1 and digits != {"12175557713"} and all(got[i][0].startswith("+1") for i in range(3))
    a, b = got[3][0], got[4][0].replace(" ", "")
    assert a == b != "DE89370400440532013000" and a[:2] == "DE"
    assert int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1


def test_distinct_in_digits_and_none_left_without(spark, monkeypatch):
    e = spark.createDataFrame([("phone", f"{p}{i:09d}") for i in range(40) for p in ("", "+")], "kind string, value string")
    rows = pii.surrogate_table(e, "k").collect()
    assert len({re.sub(r"\D", "", r.surrogate) for r in rows} | {f"{i:09d}" for i in range(40)}) == 80 + 40
    monkeypatch.setattr(pii, "MAX_DRAWS", 1)
    many = spark.createDataFrame([("ssn", f"{i:01d}") for i in range(10)], "kind string, value string")
    rows = pii.surrogate_table(many, "k").collect()
    assert len({r.surrogate for r in rows}) == 10 and all(r.surrogate.startswith("[ssn-") for r in rows)


def test_gender_script_and_key(spark):
    got = replaced(spark, ["Госпожа Анна Иванова", "Иван Петров", "Κυρία Μαρία Παππά"])
    assert got[0][0].endswith("ова") and got[1][0].endswith("ов") and got[2][0].endswith("ίδου")
    assert replaced(spark, ["Anna Lee"], "one") != replaced(spark, ["Anna Lee"], "two")
    with pytest.raises(ValueError):
        replaced(spark, ["a"], "")
    with pytest.raises(ValueError):
        pii.replace_pii(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, PII_count long"), "k")


def test_rows_stay_beside_clashing_columns(spark):
    rows = [(1, "Anna Lee", "a", b"x", 1), (1, "Anna Lee", "a", b"x", 1), (None, None, None, None, None), (2, "", "v", b"", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, value string, _key binary, kind int")
    got = pii.replace_pii(df, "k").collect()
    assert len(got) == 4 and [c for c in got[0].asDict()] == [*df.columns, "pii_count"]
    assert sorted(zlib.crc32(bytes(r._key or b"")) for r in got) == sorted(zlib.crc32(r[3] or b"") for r in rows)
    assert pii.replace_pii(df.limit(0), "k").count() == 0
