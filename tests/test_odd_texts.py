"""Text queries against their SQL on documents with odd characters, lengths and shares."""

import random

import duckdb
import pytest

import __spark_entry__ as entry


def odd_texts():
    rng = random.Random(11)
    marks = ["ß", "ﬁ", "ŉ", "ᾳ", "İ", "ı", "Σ", "σ", "ς", "ſ", "K", "É", " ", " ", "\x85", "\x0b", "\f", "\r", "\t", "\n", "\n", " ", " ", " ", "“", "”", "'", '"', "a", "B", "v", "página 7", "7", "😀", "-", "1/2", "https://x.y"]
    texts = [None, "", " ", "\n\n", "in", "a", "A", "á", "gina", "5", "x" * 59 + "ß" * 29, "x" * 59 + "1" * 40 + "ß12345", "x" * 70 + " " * 40 + "y" * 70, "página 3 ", "assinado eletronicamente a b", "https://a\x0bb"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.choice([3, 12, 40, 90, 160, 500]))) for _ in range(3000)]
    # Shares whose weighted sum or ratio lies at a tie of the third place.
    texts += ["\n".join([*("a line of twenty letters or more " + chr(97 + i) for i in range(good)), *("ab" + "-" * dashes for _ in range(bad)), *("1/2" for _ in range(noise))])
              for good in range(9) for bad in range(6) for noise in (0, 1, 3) for dashes in range(0, 30, 3)]
    return texts


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("odd"))
    rows = list(enumerate(odd_texts()))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{top}/documents.parquet")
    return top


@pytest.mark.parametrize("name", ["text_quality", "quotes_against_source", "evidence_rows"])
def test_odd_documents_as_in_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    got = entry.queries()[name](spark, odd)
    want = {r[0]: r for r in con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()}
    texts = odd_texts()
    differ = [(tuple(r), want[r.doc_id], texts[r.doc_id]) for r in got.collect() if tuple(r) != want[r.doc_id]]
    assert len(want) == len(texts) and not differ, (len(differ), differ[:3])
