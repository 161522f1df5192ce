"""Operators outside the corpus subpackage."""

import io
import zipfile

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.functions import clean
from lexmill.functions import parsing as P
from lexmill.functions import text as T
from lexmill.operators import analytics, chunking, decisions, similarity, state
from lexmill.plans import catalog
from lexmill.sources import readers, sinks
from lexmill.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cleaner():
    head = "CABECALHO DO TRIBUNAL"
    body = "\n".join(f"{head}\nlinha {i} do texto corrido\nPagina {i} de 9" for i in range(9))
    out = clean.keep_lines(body + "\nigual\nigual\n\nigual\nigual\nigual\nart. 5\nart. 5\nart. 5\n----")
    assert head not in out and "Pagina" not in out and "----" not in out
    assert out.count("igual") == 4 and out.count("art. 5") == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("Ação  nº 5\fpágina 2\nvalor TOTAL  devido", "total devido", "{x} Ok {\"a\": 1} fim")], "t string, term string, j string")
    r = df.select(T.search_form(F.col("t")).alias("s"), T.evidence(F.col("t"), F.col("term")).alias("e"), T.json_object(F.lit('Sim: {"a": 1} fim')).alias("j"),
                  P.decision_of(F.lit("Voto: não  admito o recurso")).alias("d"), P.decision_of(F.lit("Exame de admissibilidade do recurso")).alias("none"), P.case_number(F.lit("Nº 123-45.2024.8.16.0001")).alias("cn"), T.sumulas(F.lit("Súmula 7 e súmula nº 283, Súmula 7")).alias("n"), T.quality(F.lit("")).alias("q"),
                  T.redact(F.lit("Recorrente: Fulano de Tal, CPF 123.456.789-09"), "full").alias("r")).first()
    assert r.s == "acao n 5 pagina 2 valor total devido" and r.e.quote == "valor TOTAL  devido" and r.none is None and r.cn == "123-45.2024.8.16.0001" and r.e.page == 2
    assert r.j == '{"a": 1}' and r.d == "INADMITIDO" and r.n == [7, 283] and r.q == 0
    assert r.r == "Recorrente: [REDACTED_PARTY_NAME], CPF [REDACTED_CPF]"


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=3000), st.integers(60, 200))
def test_chunks_cover_the_text(text, limit):
    chunks = chunking.pack(text, limit, limit // 5)
    seen = [u for own, repeated in chunks for u in own[repeated:]]
    assert "".join(text[u.start : u.end] for u in seen).split() == text.split() or "".join("".join(text[u.start : u.end] for u in seen).split()) == "".join(text.split())
    assert all(a.end <= b.start for a, b in zip(seen, seen[1:], strict=False))


def test_breaker(spark):
    b = state.Breaker(2, 60)
    assert [b.step(t, ok) for t, ok in [(0, False), (1, False), (30, True), (62, False), (70, True), (130, True)]] == [
        (True, "CLOSED"), (True, "OPEN"), (False, "OPEN"), (True, "OPEN"), (False, "OPEN"), (True, "CLOSED")]
    calls = spark.createDataFrame([("a", 2, 1.0, False), ("a", 1, 0.0, False), ("b", 1, 0.0, True)], "key string, seq long, ts double, ok boolean")
    got = {(r.key, r.seq): r.state for r in state.breaker_trace(calls, 2, 60).collect()}
    assert got == {("a", 1): "CLOSED", ("a", 2): "OPEN", ("b", 1): "CLOSED"}


def test_streaming_forms(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 00:00:05', 'a', 10), (TIMESTAMP'2024-01-01 00:00:20', 'a', 5), (TIMESTAMP'2024-01-01 00:00:21', 'b', 1) t(ts, model, tokens)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("usage", jobs.usage_by_window(stream, "model", "ts", "tokens", slide="60 seconds"), "complete"), ("firsts", jobs.first_requests(stream, "model", "ts"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert {r.model: r.usage for r in spark.table("usage").collect()} == {"a": 15, "b": 1}
    assert spark.table("firsts").count() == 2


def test_sources_and_sinks(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {w}><w:body><w:p><w:r><w:t>Um</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.docx").write_bytes(buf.getvalue())
    (tmp_path / "d/b.docx").write_bytes(b"broken")
    (tmp_path / "d/c.txt").write_text("oi")
    got = {r.path.rsplit("/", 1)[1]: (r.text, bool(r.error)) for r in readers.read_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {"a.docx": ("Um\na | b", False), "b.docx": (None, True), "c.txt": ("oi", False)}
    (tmp_path / "s").mkdir()
    (tmp_path / "s/x.json").write_text('{"metadata": {"alertas": ["A: um", "A: um"]}, "validacoes": {"e": ["B"]}}')
    (tmp_path / "s/y.json").write_text("{not json")
    assert sorted(r.alert for r in readers.snapshot_alerts(readers.read_snapshots(spark, str(tmp_path / "s"))).collect()) == ["A: um", "B"]
    failures = spark.createDataFrame([("dead_letter", "x"), ("transient", "y")], "route string, m string")
    sinks.dead_letters(failures, "route", "k" * 16, str(tmp_path / "dlq"))
    rows = sinks.read_dead_letters(spark.read.parquet(str(tmp_path / "dlq")), "k" * 16).collect()
    assert len(rows) == 1 and '"m":"x"' in rows[0].json
    with pytest.raises(ValueError):
        sinks.dead_letters(failures, "route", "", str(tmp_path / "no"))


def test_decision_ties_and_themes(spark):
    cases = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "case_id long, concluded boolean")
    signals = spark.createDataFrame([(1, 70, "ADMITIDO"), (1, 70, "INADMITIDO"), (2, 100, "INADMITIDO"), (2, 70, "ADMITIDO")], "case_id long, priority int, decision string")
    assert {r.case_id: r.decision for r in decisions.decide(cases, signals).collect()} == {1: "INCONCLUSIVO", 2: "INADMITIDO", 3: "INCONCLUSIVO", 4: "ADMITIDO"}
    themes = spark.createDataFrame([(1, 0, "dano moral", "dano moral", ["dano", "moral"], ["7"], 1), (1, 1, "dano moral", "dano moral x", ["dano"], ["7"], 5), (1, 2, "juros", "juros", ["juros"], [], 1)],
                                   "case_id long, idx long, subject string, text string, tokens array<string>, obstacles array<string>, completeness int")
    assert sorted(r.idx for r in similarity.dedup_themes(themes).collect()) == [1, 2]
    assert analytics.top_k(spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "k string"), "k", 2).collect()[1].k == "a"
