"""Rounding, truncation, payloads, labels, merges, checks, prompts, pages and versions on small cases with known answers."""

import hashlib
import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexmill.functions import canonical as J
from lexmill.functions import classify as C
from lexmill.functions import truncation as TR
from lexmill.functions.rounding import round_even
from lexmill.operators import dashboard as DB
from lexmill.operators import fallback as FB
from lexmill.operators import merging as M
from lexmill.operators import prompts as PR
from lexmill.operators import validation as V
from lexmill.sources import pages as PG
from lexmill.sources import versioned as VS


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


# --- rounding ------------------------------------------------------------------------------------

@pytest.mark.parametrize("places", [0, 1, 3, 4, 6])
def test_rounding_is_pythons(spark, places):
    rng = random.Random(places)
    xs = [29.37515, 0.5, 1.5, 2.5, -2.5, 0.0625, -0.0625, 1e-9, 0.0, 1.005, 2.675, 123456.7895, 0.1 + 0.2] + [rng.uniform(-1000, 1000) for _ in range(300)]
    xs += [float(Fraction(2 * rng.randrange(10**5) + 1, 2 * 10**places)) for _ in range(300)]
    got = [r.x for r in spark.createDataFrame([(x,) for x in xs], "v double").select(round_even(F.col("v"), places).alias("x")).collect()]
    assert got == [round(x, places) for x in xs]


# --- truncation ----------------------------------------------------------------------------------

def test_sections(spark):
    text = "capa\nI – Dados do II caso\nmais\n  II. Fatos\nIII\nfim ok\nI - de novo"
    s = one(spark, TR.sections_of(F.col("t")), t=text)
    assert (s.one, s.two, s.three) == ("I – Dados do II caso\nmais", "II. Fatos", "III\nfim ok\nI - de novo")
    for bad in ("I - a\nIII - c\nII - b", "II - b\nIII - c", "i - a\nII - b\nIII - c", "", "Item I - a\nII - b\nIII - c"):
        assert one(spark, TR.sections_of(F.col("t")), t=bad) is None


@pytest.mark.parametrize(("one_n", "two_n", "three_n"), [(100, 9000, 500), (100, 9000, 7000), (7000, 50, 500), (2900, 9000, 3000), (2990, 50, 2970), (10, 20, 30), (6200, 100, 5990)])
def test_third_section_is_kept_whole_and_the_limit_holds(spark, one_n, two_n, three_n):
    para = lambda c, n: "\n\n".join(c * 90 for _ in range(1 + n // 92))[:n]
    text = f"I – {para('a', one_n)}\nII – {para('b', two_n)}\nIII – {para('c', three_n)}"
    got = TR.truncated(spark.createDataFrame([(text,)], "t string"), "t").first()["t"]
    assert len(got) <= 6000 + len(TR.CUT_MARK)
    third = f"III – {para('c', three_n)}".strip()
    assert (third in got) == (len(third) < 6000)
    if len(text) <= 6000:
        assert got == text
    elif len(third) < 6000 and one_n + three_n < 5700:
        assert len(got) <= 6000 and got.startswith("I – ")


def test_texts_without_sections_end_after_a_paragraph(spark):
    text = "\n\n".join("p" * 500 for _ in range(20))
    got = TR.truncated(spark.createDataFrame([(text,), (None,), ("short",)], "t string"), "t").collect()
    assert got[0].t == text[: text.rfind("\n\n", 0, 6000)] + TR.CUT_MARK and got[1].t is None and got[2].t == "short"
    assert one(spark, TR.cut_text(F.col("t"), F.lit(10)), t="x" * 30) == "x" * 10 + TR.CUT_MARK


def test_query_text(spark):
    none = F.array().cast("array<string>")
    assert one(spark, TR.query_text(F.lit(""), none, F.array(F.lit("dano"), F.lit("juros")), F.lit(None).cast("string"))) == "tipo_recurso: desconhecido\ndecisao_estimada: desconhecida\nsumulas: nenhuma\nmaterias: dano, juros"


# --- payloads ------------------------------------------------------------------------------------

def test_equal_payloads_have_one_form(spark):
    same = ['{"b": 1.0, "a": [{"z": "1.0", "y": 2.50}, 1e2, 10000000000]}', '{"a":[{"y":25e-1,"z":"1.0"},100,1e10],"b":1}', ' {"a" : [ {"z":"1\\u002e0","y":2.5} , 100.0, 1.0E10 ], "b":1}']
    forms = [r.x for r in spark.createDataFrame([(s,) for s in same], "s string").select(J.canonical_json(F.col("s")).alias("x")).collect()]
    assert set(forms) == {'{"a":[{"y":2.5,"z":"1.0"},100,10000000000],"b":1}'}
    assert json.loads(forms[0]) == json.loads(same[0])
    for bad in ("", "nope", '{"a": 1', '{"a":1,"a":2}', None):
        assert spark.createDataFrame([(bad,)], "s string").select(J.payload_hash(F.col("s")).alias("x")).first().x is None
    apart = ['{"a":"1"}', '{"a":1}', '{"a":[1]}', '{"a":1.5}', '{"a":null}', "{}", '{"a":12345678901234567890.5}', '{"a":12345678901234567890.25}', '{"a":-1}', '{"a":"x\\"1.0\\""}']
    marks = [r.x for r in spark.createDataFrame([(s,) for s in apart], "s string").select(J.payload_hash(F.col("s")).alias("x")).collect()]
    assert len(set(marks)) == len(apart) and None not in marks


def test_payload_rows(spark):
    p = one(spark, J.payload_row(F.col("s"), J.STAGE_THREE), s='{"decisao":"ADMITIDO","fundamentos_decisao":"not a list","aviso_inconclusivo":true}')
    assert (p.decisao, p.aviso_inconclusivo, p.minuta_completa) == ("ADMITIDO", True, None)
    assert one(spark, J.payload_row(F.col("s"), J.STAGE_THREE), s="[1]") is None
    assert one(spark, J.stage_two_themes(F.col("s")), s='{"temas": 5}') == []


# --- labels --------------------------------------------------------------------------------------

def lit(appeal, ruling, label):
    return F.struct(F.lit(appeal).alias("appeal"), F.lit(ruling).alias("ruling"), F.lit(label).alias("label"))


def said(label, confidence):
    return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))


NOBODY = "cast(null as struct<label: string, confidence: double>)"


@pytest.mark.parametrize(("heur", "verifier", "model", "want"), [
    ((0.9, 0.1, C.APPEAL), (C.APPEAL, 0.8), None, (C.APPEAL, round((0.55 * 0.9 + 0.1 * 0.8) / 0.65, 3), [])),
    ((0.9, 0.1, C.APPEAL), (C.UNKNOWN, 0.0), (C.RULING, 0.9), (C.UNKNOWN, 0.49, ["strong_heuristic_llm_conflict"])),
    ((0.2, 0.3, C.UNKNOWN), (C.UNKNOWN, 0.0), (C.APPEAL, 0.95), (C.APPEAL, round((0.25 * 0.5 + 0.35 * 0.95) / 0.6, 3), [])),
    ((0.2, 0.3, C.UNKNOWN), (C.RULING, 0.6), (C.APPEAL, 0.95), (C.UNKNOWN, 0.49, ["crosscheck_conflict"])),
    ((0.0, 0.0, C.UNKNOWN), (C.UNKNOWN, 0.0), (C.UNKNOWN, 0.0), (C.UNKNOWN, 0.49, ["low_composite_confidence", "low_composite_margin"])),
    ((0.8, 0.8, C.RULING), (C.UNKNOWN, 0.0), None, (C.RULING, 0.8, [])),
])
def test_composite_with_model(spark, heur, verifier, model, want):
    c = one(spark, C.composite_with_model(lit(*heur), said(*verifier), said(*model) if model else F.expr(NOBODY)))
    assert (c.label, round(c.confidence, 3), c.flags) == want


def test_known_labels_never_reach_the_model(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def scorer(texts):
        for t in texts:
            (log / hashlib.sha256(t.encode()).hexdigest()).write_text(t)
        if any("fails" in t for t in texts):
            raise RuntimeError("down")
        return [("recurso", 1.0)] * len(texts)

    known = "Recurso Especial com base no art. 105, III. razoes recursais. PROJUDI - Recurso: interposicao de recurso"
    docs = spark.createDataFrame([(1, known), (2, "Texto livre"), (3, None), (4, "it fails")], "doc long, body string")
    got = {r.doc: r for r in FB.classify_documents(docs, "doc", "body", scorer, 1000).collect()}
    asked = {p.read_text() for p in log.iterdir()}
    assert got[1].label == C.APPEAL and not got[1].asked and known not in asked
    assert asked == {"Texto livre", "", "it fails"}
    assert got[2].asked and got[2].label == C.APPEAL and got[4].label == C.UNKNOWN and "tipo_desconhecido" in got[4].reasons


def test_review_reasons(spark):
    comp = F.struct(F.lit(C.UNKNOWN).alias("label"), F.lit(0.49).alias("confidence"), F.lit(0.1).alias("margin"), F.array(F.lit("low_composite_margin")).alias("flags"))
    assert one(spark, C.manual_review(comp)) == ["tipo_desconhecido", "confianca_baixa<0.65:0.490", "margem_baixa<0.15:0.100", "consistencia:low_composite_margin"]


# --- merges --------------------------------------------------------------------------------------

def test_merge_chunks(spark):
    rows = [("a", 2, "", "", "Maria Santos", False, ["Art. 927 do CC", "Art. 389 do CPC", " "], "two", None), ("a", 1, "12345-67", "João Silva", "", False, ["Art. 927 do CC", "art. 186 do CC", "ART. 186 DO CC"], "one", None),
            ("a", 3, "99", "Outro", " ", True, None, " ", "p3"), ("b", 1, None, None, None, None, [], None, "p1")]
    parts = spark.createDataFrame(rows, "case string, chunk int, number string, appellant string, appellee string, free boolean, provisions array<string>, text string, proof string").repartition(4)
    got = {r.case: r for r in M.merge_chunks(parts, "case", "chunk", ["number", "appellant", "appellee"], ["free"], {"provisions": 3}, ["text"], {"proof": "number"}).collect()}
    a = got["a"]
    assert (a.number, a.appellant, a.appellee, a.free) == ("12345-67", "João Silva", "Maria Santos", True)
    assert a.provisions == ["Art. 927 do CC", "art. 186 do CC", "Art. 389 do CPC"]
    assert a.text == "one\n\n---\n\ntwo" and a.proof == "p3"
    b = got["b"]
    assert (b.number, b.free, b.provisions, b.text, b.proof) == ("", False, [], "", "p1")
    exact = {r.case: r for r in M.merge_chunks(parts, "case", "chunk", lists={"provisions": 9}, fold=False).collect()}
    assert exact["a"].provisions == ["Art. 927 do CC", "art. 186 do CC", "ART. 186 DO CC", "Art. 389 do CPC"]


def test_compaction(spark):
    themes = spark.createDataFrame([("k", 2, 1, "juros", None, "constitucional", "", [f"Súmula {i}" for i in range(9)], None), ("k", 1, 1, "dano", "negado", None, None, [], ["t1", "t2"])],
                                   "k string, chunk int, idx int, materia_controvertida string, conclusao_fundamentos string, natureza_fundamento string, base_vinculante string, obices_sumulas array<string>, trechos_chave array<string>")
    first, second = (r.block.split("\n") for r in M.compact_second_stage(themes, "k", "chunk", "idx").orderBy("n").collect())
    assert first == ["Tema consolidado 1 (origem chunk 1):", "matéria: dano", "conclusão e fundamentos: negado", f"natureza do fundamento: {M.ABSENT}", f"base vinculante: {M.ABSENT}", f"óbices/súmulas: {M.ABSENT}", "trechos chave: t1 | t2"]
    assert second[0] == "Tema consolidado 2 (origem chunk 2):" and second[4] == "base vinculante: " and second[5] == "óbices/súmulas: " + "; ".join(f"Súmula {i}" for i in range(6))


# --- checks --------------------------------------------------------------------------------------

PROOF = "struct<quote: string, page: int, anchor: string>"


def test_stage_two_checks(spark):
    schema = f"case_id long, idx int, theme struct<subject: string, conclusion: string, obstacles: array<string>, excerpt: string>, evidence map<string, {PROOF}>"
    whole = {f: ("q", 1, "a") for f in V.ESSENTIAL}
    themes = spark.createDataFrame([(1, 1, ("s", "c", ["o"], "e"), whole), (2, 1, ("s", "", None, "e"), whole | {"subject": (" ", 0, None)}), (2, 2, ("s", "c", ["o"], "e"), {})], schema)
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    got = {(r.case_id, r.idx): r.errors for r in V.stage_two_errors(cases, themes).collect()}
    assert got == {(3, None): ["no themes"], (2, 1): ["missing: conclusion", "missing: obstacles", "no quote: subject", "no page: subject", "no anchor: subject"], (2, 2): [f"no evidence: {f}" for f in V.ESSENTIAL]}


def test_theme_evidence_and_backfill(spark):
    source = "Página 3\nO acórdão trata de Dano  Moral.\nAplica a Súmula 7 do STJ."
    theme = F.expr("named_struct('subject', 'dano moral', 'conclusion', ' ', 'obstacles', array('', 'Súmula 83', 'súmula 7'), 'excerpt', 'x')")
    given = F.expr(f"map('subject', named_struct('quote', 'nowhere', 'page', 1, 'anchor', 'a'), 'excerpt', cast(named_struct('quote', 'Súmula 7', 'page', null, 'anchor', '') as {PROOF}))")
    assert one(spark, V.theme_evidence_alerts(theme, given, F.lit(source))) == ["quote not in source: subject", "no evidence: obstacles", "no page: excerpt", "no anchor: excerpt"]
    none = F.expr("cast(null as struct<quote: string, page: int, anchor: string, start: int>)")
    e = one(spark, V.backfilled(F.lit("dano moral"), none, F.lit(source)))
    assert e.quote == "O acórdão trata de Dano  Moral." and e.page == 3 and e.start == source.index("Dano")
    part = F.expr("cast(named_struct('quote', 'mine', 'page', null, 'anchor', '', 'start', null) as struct<quote: string, page: int, anchor: string, start: int>)")
    e = one(spark, V.backfilled(F.lit("dano moral"), part, F.lit(source)))
    assert e.quote == "mine" and e.page == 3 and e.anchor
    assert one(spark, V.backfilled(F.lit(" "), part, F.lit(source))).quote == "mine" and one(spark, V.backfilled(F.lit("absent"), none, F.lit(source))) is None
    e = one(spark, V.backfilled_any(F.array(F.lit(""), F.lit("Súmula 83"), F.lit("súmula 7")), none, F.lit(source)))
    assert e.quote == "Aplica a Súmula 7 do STJ."


# --- prompts -------------------------------------------------------------------------------------

def test_prompt_contract_and_signature(spark):
    rows = [("p", "system", "> **Versão**: 2.1 **\nRegras Gerais"), ("p", "dev", "Formato\nversao: 2.1"), ("q", "dev", "formato"), ("q", "system", "  "), ("r", "system", None)]
    df = spark.createDataFrame(rows, "prompt string, component string, content string")
    required = spark.createDataFrame([("system", None), ("system", "regras gerais"), ("dev", "FORMATO"), ("dev", "Tema 1")], "component string, marker string")
    got = {r.prompt: (r.complete, r.missing, r.unmarked) for r in PR.prompt_gaps(df, required).collect()}
    assert got == {"p": (False, [], ["dev: Tema 1"]), "q": (False, ["system"], ["dev: Tema 1"]), "r": (False, ["dev", "system"], [])}
    assert all(r.complete for r in PR.prompt_gaps(df.where("prompt = 'p'"), required.where("marker is null or marker <> 'Tema 1'")).collect())
    marks = {r.prompt: r for r in PR.prompt_signatures(df).collect()}
    want = hashlib.sha256("[dev]\nFormato\nversao: 2.1\n\n[system]\n> **Versão**: 2.1 **\nRegras Gerais".encode()).hexdigest()
    assert (marks["p"].sha256, marks["p"].version, marks["p"].components) == (want, "2.1", 2)
    assert (marks["q"].version, marks["q"].components, marks["r"].sha256) == ("unversioned", 1, "")
    turned = PR.prompt_signatures(df.orderBy(F.desc("component"))).where("prompt = 'p'").first()
    assert turned.sha256 == want
    two = df.where("prompt = 'p'").union(spark.createDataFrame([("p", "x", "<!-- version: 9 -->")], df.schema))
    assert PR.prompt_signatures(two).first().version == "composite:2.1,9"


# --- pages ---------------------------------------------------------------------------------------

def test_page_source(spark, tmp_path):
    # Within the test, so that they go to the workers by value.
    def first_engine(data):
        text = data.decode()
        if text.startswith("LOCKED"):
            raise PG.Encrypted("password")
        if text.startswith("BROKEN"):
            raise ValueError("no header")
        return text.split("\f")

    def second_engine(data):
        if data.startswith(b"BROKEN ALL"):
            raise ValueError("none")
        return ["second " + data.decode()]

    long = "\f".join(f"page {i} " + "x" * 80 for i in range(3))
    files = {"a.pdf": long, "sub/b.PDF": "few", "c.pdf": "LOCKED", "d.pdf": "BROKEN", "e.pdf": "BROKEN ALL", "f.txt": long, "g.pdf": ""}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    df = PG.read_pages(spark, str(tmp_path), [("one", first_engine), ("two", second_engine)], partition_bytes=200)
    rows = {}
    for r in sorted(df.collect(), key=lambda r: (r.path, r.page or 0)):
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert sorted(rows) == ["a.pdf", "b.PDF", "c.pdf", "d.pdf", "e.pdf", "g.pdf"]
    assert [r.page for r in rows["a.pdf"]] == [0, 1, 2] and {r.engine for r in rows["a.pdf"]} == {"one"}
    assert all(r.sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows["a.pdf"])
    assert rows["b.PDF"][0].text == "second few" and rows["d.pdf"][0].engine == "two"
    assert rows["c.pdf"][0].error.startswith("encrypted") and rows["c.pdf"][0].page is None and rows["e.pdf"][0].error.startswith("corrupted: ValueError")
    assert df.rdd.getNumPartitions() >= 2
    empty = tmp_path / "none"
    empty.mkdir()
    assert PG.read_pages(spark, str(empty), [("one", first_engine)]).count() == 0


def test_longer_ocr_wins_where_there_is_little_text(spark):
    pages = spark.createDataFrame([(1, 0, "x" * 30, "one"), (2, 0, "x" * 500, "one"), (3, 0, "abc", "one"), (3, 1, None, "one"), (4, 0, "x" * 30, "one")], "doc_id long, page int, text string, engine string")
    ocr = spark.createDataFrame([(1, 0, "y" * 31), (2, 0, "y" * 900), (3, 1, "cd"), (3, 0, "ab"), (4, 0, "y" * 30)], "doc_id long, page int, text string")
    got = {r.doc_id: (r.text, r.n_pages) for r in PG.assemble(PG.keep_longer(pages, ocr)).collect()}
    assert got == {1: ("y" * 31, 1), 2: ("x" * 500, 1), 3: ("ab\ncd", 2), 4: ("x" * 30, 1)}


# --- versions ------------------------------------------------------------------------------------

def test_reviews_survive_an_import_and_a_killed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda *r: spark.createDataFrame(r, "id string, kind string")
    VS.import_references(rows(("a", "REsp"), ("b", "RE")), path)
    assert {(r.id, r.avaliacao, r.notas_revisao) for r in VS.read_current(spark, path).collect()} == {("a", "pendente", ""), ("b", "pendente", "")}
    seen = VS.read_current(spark, path).withColumn("avaliacao", F.when(F.col("id") == "a", "boa").otherwise(F.col("avaliacao"))).withColumn("assessor_revisor", F.lit(None).cast("string"))
    VS.write_version(seen, path)
    VS.import_references(rows(("a", "AREsp"), ("c", "RE")), path)
    got = {r.id: (r.kind, r.avaliacao, r.assessor_revisor) for r in VS.read_current(spark, path).collect()}
    assert got == {"a": ("AREsp", "boa", ""), "c": ("RE", "pendente", "")}
    before = VS.current_version(spark, path)
    broken = rows(("a", "new")).withColumn("kind", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        VS.write_version(broken, path)
    assert VS.current_version(spark, path) == before and VS.read_current(spark, path).count() == 2
    both = VS.merge_reviews(rows(("a", "x")), VS.read_current(spark, path), "id", VS.REVIEWS, gone=True)
    assert {(r.id, r.kind, r.avaliacao) for r in both.collect()} == {("a", "x", "boa"), ("c", "RE", "pendente")}


# --- dashboard -----------------------------------------------------------------------------------

RUNS = "seconds double, tokens long, prompt long, completion long, model string, decision string, week string, failed array<string>, alerts array<string>, calls long, truncated long, latency double, covered long, fields long"


def test_dashboard(spark, tmp_path):
    rows = [(1.0005, 10, 1_000_000, 0, "gpt-4o", " admitido", "2024-W01", ["etapa1"], ["evidência", "x"], 4, 1, 10.0, 1, 2), (2.0, 11, 0, 1_000_000, None, "INCONCLUSIVO", None, None, None, None, None, None, None, None),
            (0.0, 0, 0, 0, "mini", "nulo", "2024-W01", [], ["x"], 3, 0, 2.5, 2, 3)]
    prices = spark.createDataFrame([("gpt-4o", "2.5", "10"), ("mini", "0.15", "0.6")], "model string, input_per_1m string, output_per_1m string")
    runs = DB.with_cost(spark.createDataFrame(rows, RUNS), prices, ("2.5", "10"))
    out = DB.dashboard(runs)
    got = {(r.category, r.metric, r.week): r.value for r in out.collect()}
    assert got["execucoes", "total", ""] == 3 and got["execucoes", "com_decisao", ""] == 3 and got["custo_estimado_usd", "total", ""] == 12.5
    assert got["latencia", "media_s", ""] == round((1.0005 + 2) / 3, 3) and got["latencia", "max_s", ""] == 2 and got["latencia", "min_s", ""] == 0
    assert got["erro_por_etapa", "etapa1", ""] == 0.333 and got["retrabalho_retry", "taxa_por_call", ""] == round(1 / 7, 3) and got["cobertura_evidencia", "taxa", ""] == 0.6
    assert got["distribuicao_decisao_por_semana", "ADMITIDO", "2024-W01"] == 1 and got["distribuicao_decisao_por_semana", "INADMITIDO", "2024-W01"] == 0 and got["distribuicao_decisao_por_semana", "INCONCLUSIVO", "sem_data"] == 1
    assert got["top_alertas_validacao", "x", ""] == 2 and got["alertas_validacao", "minutas_com_alerta", ""] == 2 and got["llm", "latencia_media_ms", ""] == round(12.5 / 3, 2)
    DB.export_csv(out, str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert lines[0] == "categoria,metrica,semana,valor" and len(lines) == 1 + 3 + 6 + 2
    empty = {(r.category, r.metric): r.value for r in DB.dashboard(runs.limit(0)).collect()}
    assert len(empty) == 24 and set(empty.values()) == {0.0}


def test_dashboard_reads_the_runs_once(spark, tmp_path):
    rows = [(1.0, 1, 1, 1, "m", "ADMITIDO", "w", None, None, 1, 0, 1.0, 1, 1)]
    spark.createDataFrame(rows, RUNS).withColumn("cost", F.lit(1).cast("decimal(28,6)")).write.parquet(str(tmp_path / "runs"))
    plan = DB.dashboard_sums(spark.read.parquet(str(tmp_path / "runs")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


# --- prompt assembly, rotation, events -----------------------------------------------------------

def test_prompt_assembly(spark):
    parts = spark.createDataFrame([("p", "system_base", " base "), ("p", "dev1", "dev"), ("p", "referencias_longas", "refs"), ("q", "SYSTEM_PROMPT", "old"), ("q", "system_base", "base"), ("r", "dev1", " ")], "prompt string, component string, content string")
    rows = [(1, "p", "Etapa1", " t ", None, None), (2, "p", "etapa1", "t", " c ", True), (3, "p", "etapa2", "t", "", None), (4, "q", "etapa1", "t", None, None), (5, "r", "etapa1", "t", None, None), (6, None, None, None, None, None)]
    asked = spark.createDataFrame(rows, "request_id int, prompt string, stage string, task string, context string, references boolean")
    got = {r.request_id: (r.profile, r.messages and [tuple(m) for m in r.messages]) for r in PR.assemble_prompts(asked, parts, {"etapa1": "dev1"}).collect()}
    assert got[1] == ("modular", [("system", "base"), ("developer", "dev"), ("user", "t")])
    assert got[2] == ("modular", [("system", "base"), ("developer", "dev"), ("developer", "refs"), ("user", "[CONTEXTO ADICIONAL]\nc\n\n[TAREFA]\nt")])
    assert got[3] == ("missing", None) and got[4] == ("legacy-fallback", [("system", "old"), ("user", "t")]) and got[5] == ("missing", None) and got[6] == ("missing", None)
    least = {r.request_id: r for r in PR.assemble_prompts(asked, parts, {"etapa1": "dev1"}, ("etapa1",), "min").collect()}
    assert least[5].profile == "minimal-fallback" and len(least[1].messages) == 4


def test_rotation(spark):
    said = [("Page 1\nRotate: 90\n",), ("rotate:270",), ("Rotate: 45",), ("",), (None,), ("Rotate: 99999999999",)]
    assert [r.x for r in spark.createDataFrame(said, "t string").select(V.page_rotation(F.col("t")).alias("x")).collect()] == [90, 270, 0, 0, 0, 0]


def test_events_and_audit_rows(spark):
    from lexmill.sources import sinks

    rows = spark.sql("select 7L as case_id, 'e1' as run, 'etapa1' as stage, timestamp_ntz'2024-05-01 10:00:00' as ts, 3 as pages, cast(null as string) as note")
    e = sinks.stage_events(rows, "extracao", "case_id", "run", "stage", "ts", ["pages", "note"]).first()
    assert json.loads(e.payload) == {"etapa": "etapa1", "evento": "extracao", "execucao_id": "e1", "pages": 3, "processo_id": "7", "timestamp": "2024-05-01T10:00:00"}
    assert list(json.loads(e.payload)) == sorted(json.loads(e.payload))
    done, failed = spark.sql("select explode(array(1, 2)) as c"), spark.sql("select 2 as c, 'x' as what, 'etapa2' as at")
    assert {tuple(r) for r in sinks.with_error_rows(done, failed, "c", "what", "at").collect()} == {(1, True, "", ""), (2, False, "etapa2", "x")}


def test_final_decisions_and_hints(spark):
    from lexmill.operators import decisions as D

    rows = spark.createDataFrame([(1, "INCONCLUSIVO", "ADMITIDO", " texto ", ["Conflito", "conflito "], ["x"], ["a"], ["A", "b"]), (2, "INCONCLUSIVO", "", None, [], None, None, None), (3, "ADMITIDO", None, "minuta", ["f"], None, None, None),
                                  (4, "INCONCLUSIVO", "INCONCLUSIVO", "AVISO: decisão muito inconclusiva", None, None, None, None)],
                                 "case_id int, computed string, said string, draft string, grounds array<string>, given_grounds array<string>, given_items array<string>, collected_items array<string>")
    got = {r.case_id: r for r in D.final_decisions(rows).collect()}
    assert got[1].draft == f"AVISO: {D.WARNING} Motivo: Conflito\n\ntexto" and got[1].diverges and got[1].grounds == ["Conflito", "x"] and got[1].items == ["a", "b"] and got[1].reason == "Conflito"
    assert got[2].draft == f"AVISO: {D.WARNING}" and got[2].reason == D.NO_GROUNDS and not got[2].diverges and got[2].warned
    assert (got[3].draft, got[3].code, got[3].warned, got[3].decision) == ("minuta", "", False, "ADMITIDO") and got[4].draft == "AVISO: decisão muito inconclusiva"
    none, some = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    assert one(spark, V.retry_hints(some, none, none)) == ["Fill in the missing fields: a | b"]
    assert len(one(spark, V.retry_hints(none, none, none))) == 1 and len(one(spark, V.retry_hints(some, some, some, F.lit("bad")))) == 5


def test_reports(spark, tmp_path):
    from lexmill.sources import readers, sinks

    for name, text in {"quality_gate_report_2.json": '{"passed": false, "generated_at": "2024-02-01"}', "quality_gate_report_1.json": '{"passed": true, "generated_at": "2024-01-01", "gates": []}', "quality_gate_report_3.json": "nope", "other.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    got = [(r.file, r.passed) for r in readers.read_reports(spark, str(tmp_path)).orderBy("file").collect()]
    assert got == [("quality_gate_report_1.json", True), ("quality_gate_report_2.json", False), ("quality_gate_report_3.json", None)]
    for v, c in (("v1", "case_a"), ("v2", "case_b")):
        (tmp_path / "golden" / v).mkdir(parents=True)
        (tmp_path / "golden" / v / f"{c}.json").write_text('{"name": "n"}')
    cases = readers.read_golden_cases(spark, str(tmp_path / "golden"), "name string").collect()
    assert {(r.version, r.case, r.name) for r in cases} == {("v1", "case_a", "n"), ("v2", "case_b", "n")}
    gates = spark.createDataFrame([("a", 0.9, 0.8, True), ("b", 0.1, 0.8, False)], "metric string, observed double, threshold double, passed boolean")
    assert sinks.gate_report(gates).first().passed is False and sinks.gate_report(gates.limit(0)).first().passed is False
    for run in ("r1", "r2", "r1"):
        sinks.write_report(gates, str(tmp_path / "reports"), "gate", run)
    assert spark.read.json(str(tmp_path / "reports")).groupBy("run").count().orderBy("run").collect() == [("r1", 2), ("r2", 2)]
    lines = [r.line for r in sinks.metrics_markdown(gates.selectExpr("metric", "observed as value"), "Baseline").orderBy("place").collect()]
    assert lines == ["# Baseline", "- a: 0.9000", "- b: 0.1000"]
