"""Parsers and validators against hand-made cases and plain-Python statements of their rules, with nulls, empty tables and clashing columns."""

import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from lexmill.functions import parsing as P
from lexmill.functions import text as T
from lexmill.operators import analytics, chunking, decisions
from lexmill.operators import validation as V
from pyspark.sql import functions as F


def test_answer_and_themes_of_nulls_and_blanks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n")], "k long, text string")
    for r in df.select("k", P.answer_row(F.col("text")).alias("a"), P.theme_blocks(F.col("text")).alias("b"), P.decision_of(F.col("text")).alias("d")).collect():
        assert (r.a.case_number, r.a.appellant, r.a.species, r.a.basis) == ("", "", "", "") and r.d is None and not r.b and not r.a.provisions


def test_provisions_section_and_articles(spark):
    texts = ["Dispositivos violados:\n- art. 5 da Lei 1\n* CPC, art. 9\nnada\n\nFim", "Violado o art. 12 do CC, art. 3; ART. 7", "nada", "Dispositivo violado:\n**x"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.p for r in df.select("k", P.provisions(F.col("text")).alias("p")).collect()}
    assert got == {0: [". 5 da Lei 1", "CPC, art. 9"], 1: ["art. 12 do CC", "art. 3", "ART. 7"], 2: [], 3: []}


def test_theme_fields_end_at_the_next_line_of_letters(spark):
    block = "Tema 1: x\nConclusão: a\n12 b\n\"c\nóbices: Súmula 7 e súmula nº 83\nFundamentos: *d*\nTrecho: 'lit'"
    r = spark.createDataFrame([(block,)], "b string").select(P.theme_row(F.col("b")).alias("t")).first().t
    assert (r.conclusion, r.obstacles, r.excerpt) == ("a\n12 b\n\"c\nóbices: Súmula 7 e súmula nº 83", ["Súmula 7", "Súmula 83"], "lit")


def test_json_objects(spark):
    texts = ['x {"a": {"b": "}"}} y', '{"a": 1} {"b": 2}', '{"a": 1} } y', "{a}", None, "", '{"a": "\\"}"}']
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert {r.k: r.j for r in df.select("k", T.json_object(F.col("text")).alias("j")).collect()} == {0: '{"a": {"b": "}"}}', 1: None, 2: None, 3: None, 4: None, 5: None, 6: '{"a": "\\"}"}'}


def test_evidence_merge_and_completeness(spark):
    e = "struct<quote string, page int, anchor string, start int>"
    df = spark.createDataFrame([(1, None, ("q", 2, "a", 5)), (2, ("", 0, "x", 0), ("q", 2, "a", 5))], f"k long, given {e}, made {e}")
    got = {r.k: tuple(r.m) for r in df.select("k", P.merged_evidence(F.col("given"), F.col("made")).alias("m")).collect()}
    assert got == {1: ("q", 2, "a", 5), 2: ("q", 2, "x", 0)}
    theme = spark.createDataFrame([(("s", "c", " ", ["7"], ""), {"subject": ("q", 1, ""), "excerpt": ("", None, "a")})],
                                  "t struct<subject string, conclusion string, binding string, obstacles array<string>, excerpt string>, e map<string, struct<quote string, page int, anchor string>>")
    assert theme.select(V.completeness(F.col("t"), F.col("e")).alias("s")).first().s == 5 + 0.75 + 0.25


def test_checks_of_nulls(spark):
    df = spark.createDataFrame([(None, None, None), ("7", ("texto 7", 1, "a"), True), ("7", (None, None, None), False)], "v string, e struct<quote string, page int, anchor string>, ok boolean")
    rows = df.select(V.evidence_alerts("case_number", F.col("v"), F.col("e")).alias("a"), V.field_score(F.col("v"), F.col("e"), F.col("ok")).alias("s")).collect()
    assert [r.a for r in rows] == [[], [], ["no quote: case_number", "no page: case_number", "no anchor: case_number"]]
    assert [round(r.s, 3) for r in rows] == [0, 1, round(2 / 6, 3)]
    reason = spark.createDataFrame([(["a", "b", "a"],), ([],)], "a array<string>").select(V.inconclusive_reason(F.col("a"), 4).alias("r")).collect()
    assert [r.r for r in reason] == ["a | ", ""]


def test_streak_by_time(spark):
    day = lambda d: d and datetime.datetime(2024, 1, d)
    cases = [([(1, 1, True), (2, 2, True), (3, 3, True)], (3, 3, 3, 0, True)), ([(1, 1, False), (2, 3, True), (3, 3, True), (4, 4, True)], (4, 3, 3, 1, False)),
             ([(1, 1, True), (2, None, True), (3, 1, True)], (3, 3, 3, 2, False)), ([(1, 1, True)], (1, 1, 1, 1, False)), ([], (0, 0, 0, 1, False))]
    for rows, want in cases:
        df = spark.createDataFrame([(o, day(d), p) for o, d, p in rows], "run long, ts timestamp_ntz, passed boolean")
        assert tuple(analytics.timed_streak(df, "run", "ts", "passed", 3).first()) == want


def test_pages_and_reasons(spark):
    pages = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", True), (1, 2, "c", False), (2, 0, None, True)], "doc_id long, page long, text string, wanted boolean")
    ocr = spark.createDataFrame([(1, 0, "A"), (1, 1, " \n"), (1, 2, "C")], "doc_id long, page long, text string")
    assert {(r.doc_id, r.page): (r.text, r.replaced) for r in V.merge_ocr(pages, ocr).collect()} == {(1, 0): ("A", True), (1, 1): ("b", False), (1, 2): ("c", False), (2, 0): (None, False)}
    listed = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (1, 0), (3, 1)], "doc_id long, number long")
    assert sorted(map(tuple, V.wanted_pages(listed, spark.createDataFrame([(1, 3)], "doc_id long, n_pages long")).collect())) == [(1, 0)]
    codes = spark.createDataFrame([("E1_INCONCLUSIVA", None), ("x", " own "), (None, None)], "code string, said string")
    assert [r.block_reason for r in decisions.with_block_reason(codes, "code", "said").collect()] == ["Etapa 1 inconclusiva, execução bloqueada antes da Etapa 2.", "own", ""]


def test_grounded_obstacles(spark):
    source = "Aplica-se o enunciado n. 83 e a SÚMULA 7/STJ; falta de  prova."
    rows = ["Súmula 83", "súmula 7", "falta de prova", "Súmula 211", "", "sem base"]
    df = spark.createDataFrame([(r, source) for r in rows], "o string, s string")
    assert [r.g for r in df.select(V.grounded_obstacle(F.col("o"), F.col("s")).alias("g")).collect()] == [True, True, True, False, True, False]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n!?", max_size=1500), st.integers(60, 120))
def test_pieces_of_a_paragraph_are_of_bounded_size(text, limit):
    for u in chunking.units(text, limit):
        assert u.end - u.start <= max(200, limit * 4) + 202 and text[u.start : u.end].strip() and u.section == "PREAMBULO"


def test_sections_of_chunks():
    own = chunking.units("intro\n\nEmenta\nresumo\n\nVOTO\n\nfim\n\nVOTO DE QUALIDADE", 100)
    assert [u.section for u in own] == ["PREAMBULO", "EMENTA", "VOTO", "VOTO", "VOTO"]
