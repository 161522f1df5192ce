"""Operators against brute force where queries meet every row."""

import math
import random
import re
from difflib import SequenceMatcher

from lexmill.functions import text as T
from lexmill.operators import similarity
from lexmill.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def span_of(text, term):
    """The reference's search."""
    own = (term or "").strip()
    if not text or not own:
        return None
    found = re.search(re.escape(own), text, re.IGNORECASE) or re.search(r"\s+".join(map(re.escape, own.split())), text, re.IGNORECASE)
    return found and (found.start(), found.end() - found.start())


def test_evidence_and_quotes_cover_every_document(spark, tmp_path):
    given = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = "a quotation of more than thirty characters"
    texts = [*given, None, "", " \n ", "İstanbul 😀 um valor\n\tde 12 é ação (x) + y", "x" * 20, f"“{long}” and '{long}' and «{long}»", f"´{long}`", '"short"']
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.start, r.n) for r in catalog.QUERIES["evidence_span"](spark, str(tmp_path)).collect()}
    assert got == {i: span_of(t, (t or "")[len(t or "") // 2 :][:12].upper()) or (-1, 0) for i, t in rows}
    plain = str.maketrans(dict.fromkeys("“”„‟«»‹›‘’‚‛'`´′″", '"'))
    want = {}
    for i, t in rows:
        own = (t or "").translate(plain)
        found = re.findall(r'"([^"]{30,})"', own)
        want[i] = (sum(x.strip()[:100] in own for x in found), len(found))
    assert {r.doc_id: (r.grounded, r.quotes) for r in catalog.QUERIES["quotes_grounded"](spark, str(tmp_path)).collect()} == want
    loose = spark.createDataFrame([("😀 valor\n total  Devido", " VALOR total devido "), ("a\\b.c", "A\\B.C"), ("abc", "a.c"), (None, "a"), ("a", None)], "t string, w string")
    assert [r.s and tuple(r.s) for r in loose.select(T.span(F.col("t"), F.col("w")).alias("s")).collect()] == [(2, 22), (0, 5), None, None, None]


def chosen(query, refs):
    """The reference's selection; (ref_id, linear) or None."""
    def linear(r):
        out = 10 if r["kind"] == query["kind"] else 2 if query["kind"] and r["kind"] == "desconhecido" else 0
        out += 5 if query["decision"] and r["decision"] == query["decision"] else 0
        return out - 3 * (r["decision"] == "diligencia") + 3 * len(set(query["keys"]) & set(r["keys"])) + len(set(query["topics"]) & set(r["topics"]))

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=False)) / norm if norm else 0.0

    ranked = sorted(((r, linear(r)) for r in refs), key=lambda x: -x[1])
    best, most, top = ranked[0], max(0, ranked[0][1]), -1.0
    semantic = None
    for r, lin in ranked if query["vector"] else []:
        if r["vector"]:
            near = (cosine(query["vector"], r["vector"]) + 1) / 2
            score = 0.7 * near + 0.3 * (max(0, lin) / most if most else 0)
            if score > top:
                top, semantic = score, (r, lin, near)
    if semantic and (semantic[1] >= 5 or semantic[2] >= 0.70):
        best = semantic[:2]
    return (best[0]["ref_id"], best[1]) if best[1] >= 5 else None


def test_retrieval_meets_every_reference(spark):
    rng = random.Random(7)
    kinds, decisions, keys = ["a", "b", "desconhecido", ""], ["x", "y", "diligencia", ""], ["1", "2", "3", "4"]
    def row(i, name):
        return {name: i, "position": i, "kind": rng.choice(kinds), "decision": rng.choice(decisions), "keys": rng.sample(keys, rng.randint(0, 3)), "topics": rng.sample(keys, rng.randint(0, 2)),
                "vector": [rng.gauss(0, 1) for _ in range(4)] if rng.random() < 0.8 else []}
    rest = "position long, kind string, decision string, keys array<string>, topics array<string>, vector array<double>"
    refs = [row(i, "ref_id") for i in range(25)]
    # Queries of a kind that no reference has, and one whose semantic winner misses both limits.
    queries = [row(i, "query_id") for i in range(60)] + [row(i, "query_id") | {"kind": "none"} for i in range(60, 90)]
    few = [{"ref_id": 0, "position": 0, "kind": "a", "decision": "", "keys": [], "topics": [], "vector": [-1.0, 0.0]}, {"ref_id": 1, "position": 1, "kind": "b", "decision": "", "keys": [], "topics": [], "vector": [0.35, 1.0]}]
    falls = [{"query_id": 0, "position": 0, "kind": "a", "decision": "", "keys": [], "topics": [], "vector": [1.0, 0.0]}]
    assert chosen(falls[0], few) == (0, 10)
    for q, r in ((queries, refs), (falls, few)):
        out = similarity.retrieve(spark.createDataFrame(q, f"query_id long, {rest}").drop("position"), spark.createDataFrame(r, f"ref_id long, {rest}"))
        assert {x.query_id: (x.ref_id, x.linear) for x in out.collect()} == {x["query_id"]: c for x in q if (c := chosen(x, r))}


def test_retrieval_query_meets_all_rows_but_itself(spark):
    rows = [{"ref_id": r.vec_id, "kind": str(r.label), "decision": str(r.vec_id % 3), "keys": [], "topics": [], "vector": list(r.embedding)} for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    want = {q["ref_id"]: chosen(q, [r for r in rows if r is not q]) for q in rows if q["ref_id"] % 100 == 0}
    got = {r.query_id: (r.ref_id, r.linear) for r in catalog.QUERIES["retrieval_composite"](spark, SF).collect()}
    assert got == {k: v for k, v in want.items() if v}


def says_the_same(a, b):
    """The reference's four conditions, in full."""
    if a["subject"] and a["subject"] == b["subject"]:
        return True
    if not a["text"] or not b["text"]:
        return False
    x, y = set(a["tokens"]), set(b["tokens"])
    jac = len(x & y) / len(x | y) if x and y else 0.0
    seq = SequenceMatcher(None, a["subject"], b["subject"]).ratio() if a["subject"] and b["subject"] else 0.0
    full = SequenceMatcher(None, a["text"], b["text"]).ratio()
    n, m = ({d for o in t["obstacles"] for d in re.findall(r"\d+", o)} for t in (a, b))
    return seq >= 0.92 or seq >= 0.82 and len(x & y) >= 4 and (bool(n & m) or full >= 0.68) or jac >= 0.78 and seq >= 0.70 or 0.45 * jac + 0.35 * seq + 0.20 * full >= 0.80 and jac >= 0.58


def theme(subject, text, obstacles=()):
    return {"subject": subject, "text": text, "tokens": sorted(set(text.split())), "obstacles": list(obstacles)}


def test_each_condition_of_equivalence():
    base, far = "aaaa bbbb cccc dddd", "wxyz " * 30
    cases = [(theme("dano moral coletivo", base), theme("dano moral coletiva", far), True),  # subject alone
             (theme("abcdefghij", base), theme("abcdefghxy", base), True), (theme("abcdefghij", base), theme("pqrstuvwxy", base), False),  # jaccard needs the subject
             (theme("abcdefghijkl", base + " " + far, ["7/STJ"]), theme("abcdefghijxy", base + " " + "q " * 80, ["Súmula 7"]), True),  # obstacles
             (theme("abcdefghijkl", base + " " + far), theme("abcdefghijxy", base + " " + "q " * 80), False),
             (theme("", ""), theme("x", ""), False), (theme("abc", ""), theme("abd", ""), False), (theme("same", ""), theme("same", ""), True)]
    for a, b, same in cases:
        assert similarity.equivalent(a, b) == says_the_same(a, b) == same, (a, b)
    rng, seen = random.Random(3), set()
    for _ in range(3000):
        words = [rng.choice(["dano", "moral", "juros", "mora", "lei", "prova", "valor"]) for _ in range(rng.randint(0, 9))]
        other = [w for w in words if rng.random() < 0.85]
        a, b = (theme(" ".join(w[: rng.randint(0, 5)]), " ".join(w), rng.choice([[], ["7"], ["7/STJ"], ["83"]])) for w in (words, other))
        seen.add(want := says_the_same(a, b))
        assert similarity.equivalent(a, b) == want, (a, b)
    assert seen == {True, False}


def test_dedup_query_reads_whole_texts(spark, tmp_path):
    head = "palavra comum " * 40
    given = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    given += [(900, 0, "u", "assunto novo primeiro caso " + head + "x" * 20), (900, 1, "u", "assunto novo primeira coisa " + head + " ".join(f"outra{i}" for i in range(90)))]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    first = lambda t: re.match("[^.!?\n]*", t).group()
    told = lambda role, t: 2.0 * bool(first(t).strip()) + 2.0 * (role == "assistant") + (role == "system") + bool(re.search("[0-9]", t)) + (len(t) > 200)
    forms = df.select("conv_id", "turn", "role", F.col("text").alias("said"), T.search_form(F.regexp_extract("text", r"^[^.!?\n]*", 0)).alias("subject"), T.search_form(F.col("text")).alias("text"), similarity.token_set(F.col("text")).alias("tokens"))
    rows = forms.orderBy("conv_id", "turn").collect()
    kept = {}
    for r in rows:
        own, row = kept.setdefault(r.conv_id, []), r.asDict() | {"obstacles": re.findall("[0-9]+", r.said), "n": told(r.role, r.said)}
        at = next((i for i, k in enumerate(own) if says_the_same(row, k)), None)
        if at is None:
            own.append(row)
        elif row["n"] > own[at]["n"]:
            own[at] = row
    got = catalog.QUERIES["dedup_themes"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((c, k["turn"]) for c, own in kept.items() for k in own)
