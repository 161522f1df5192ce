"""The manifest against a plain walk over lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexmill.llm.merkle import merkle_manifest, numbered

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"
TAMPERED = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 0"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(digests, arity):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def plain(rows, arity=8):
    null_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    langs = {}
    for r in rows:
        leaf = lambda text: h(*map(frame, (r.doc_id, r.source, r.lang, r.n_chars, text)))  # noqa: B023, E731
        hit = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        now = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if hit else r.text
        langs.setdefault(r.lang, []).append((r.doc_id, leaf(r.text), leaf(now)))
    order = sorted(langs, key=null_first)
    for own in langs.values():
        own.sort(key=lambda x: (null_first(x[0]), x[1]))
    trees = {k: levels_of([x[1] for x in langs[k]], arity) for k in order}
    top = levels_of([trees[k][-1][0] for k in order], arity)
    for number, k in enumerate(order):
        for place, (doc, leaf, folded) in enumerate(langs[k]):
            proof = []
            for tree, i in ((trees[k], place), (top, number)):
                for level in tree[:-1]:
                    at = i // arity * arity
                    run = level[at : at + arity]
                    proof += run[: i - at] + run[i - at + 1 :]
                    run[i - at] = folded
                    folded = h(*run)
                    i //= arity
            yield doc, leaf, trees[k][-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, f"s{i % 3}", ["en", "de", None, "", "fr"][i * i % 5], i, f"Text No {i}") for i in range(150)]
    made += [(7, "s", "en", 1, "Again"), (7, "s", "en", 1, "Again"), (7, "s", "en", 1, "other"), (None, None, None, None, None), (None, None, None, None, None),
             (900, "s", "zz", 0, ""), (901, "s", "en", None, "Long " * 60_000), (902, "é", "en", 3, "ÉÀ A")]
    return spark.createDataFrame(made, COLUMNS)


@pytest.mark.parametrize("arity", [2, 8])
def test_manifest_is_the_plain_walk(docs, arity):
    clashing = docs.withColumns({"leaf": F.lit("x"), "tree": F.lit(1), "idx": F.lit(2), "row": F.lit(3), "n": F.lit(4)})
    got = rows_of(merkle_manifest(clashing, arity=arity, tampered=F.expr(TAMPERED)))
    assert got == sorted(plain(docs.collect(), arity), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_small_tables(spark, docs):
    assert merkle_manifest(docs.limit(0)).count() == 0
    for where in ("doc_id = 900", "lang = 'en' and doc_id < 40", "doc_id is null", "doc_id in (900, 4)"):
        own = docs.where(where)
        assert rows_of(merkle_manifest(own, tampered=F.expr(TAMPERED))) == sorted(plain(own.collect()), key=str)


def test_tampering_shows_in_the_tampered_rows_alone(docs):
    rows = merkle_manifest(docs, tampered=F.col("doc_id") == 902).collect()
    assert {r.doc_id for r in rows if not r.verified} == {902}
    assert all(r.verified for r in merkle_manifest(docs).collect())


def test_numbered_counts_rows_before(spark):
    df = spark.createDataFrame([(None, 2), ("a", 1), ("b", 5), ("é", 1), ("z", 3)], "k string, c long")
    assert {r.k: r["first"] for r in numbered(df.repartition(3), ["k"], F.col("c")).collect()} == {None: 0, "a": 2, "b": 3, "z": 8, "é": 11}
