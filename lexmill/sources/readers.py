"""Scans: run snapshots, reports, DOCX files, page tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = """metadata struct<inicio string, fim string, prompt_tokens long, completion_tokens long, total_tokens long, modelo_usado string, alertas array<string>,
 llm_stats struct<total_calls double, calls_truncadas double, latencia_media_ms double>>,
 stages struct<etapa1 struct<executada boolean, validacao_erros array<string>>, etapa2 struct<executada boolean, validacao_erros array<string>>,
 etapa3 struct<executada boolean, validacao_erros array<string>, resultado struct<decisao string>>>, alertas_validacao array<string>, validacoes map<string, array<string>>"""
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_snapshots(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Run snapshots under a folder; files that don't parse are left out."""
    return (spark.read.schema(SNAPSHOT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mode", "DROPMALFORMED").json(path))


def snapshot_alerts(snapshots: DataFrame) -> DataFrame:
    """One row for each alert of a run, from the four places that hold them, once each in a run."""
    part = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    all_ = F.concat(part("metadata.alertas"), part("alertas_validacao"), part("stages.etapa1.validacao_erros"), part("stages.etapa2.validacao_erros"), part("stages.etapa3.validacao_erros"),
                    F.flatten(F.coalesce(F.map_values("validacoes"), F.array().cast("array<array<string>>"))))
    return snapshots.select(F.explode(F.array_distinct(F.filter(all_, lambda a: F.trim(a) != ""))).alias("alert"))


REPORT = "generated_at string, passed boolean, gates array<struct<metric: string, observed: double, threshold: double, passed: boolean>>"


def read_reports(spark: SparkSession, path: str, prefix: str = "quality_gate_report_", schema: str = REPORT) -> DataFrame:
    """(file, generated_at, passed, ...) of the JSON reports of a kind in a folder, whose file names give their order; a file that doesn't parse has nulls alone."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", f"{prefix}*.json").json(path)
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_golden_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(version, case, ...) of the golden cases under v*/case_*.json of a folder."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "case_*.json").json(f"{path.rstrip('/')}/v*")
    parts = F.split(F.input_file_name(), "/")
    return rows.withColumns({"version": F.element_at(parts, -2), "case": F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")})


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with cells joined by ` | `."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = [words(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        out.append(" | ".join(words(c).strip() for c in row.findall(f"{_W}tc")))
    return "\n".join(x for x in out if x.strip())


def read_documents(spark: SparkSession, path: str, pdf_engine=None) -> DataFrame:
    """(path, text, error) of .docx, .txt and (with an injected engine bytes -> text) .pdf files."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                ext = name.rsplit(".", 1)[-1].lower()
                try:
                    if ext == "docx":
                        rows.append((name, docx_text(data), None))
                    elif ext == "txt":
                        rows.append((name, data.decode("utf-8", "replace"), None))
                    elif ext == "pdf" and pdf_engine:
                        rows.append((name, pdf_engine(data), None))
                    else:
                        rows.append((name, None, f"unsupported: {ext}"))
                except Exception as e:  # a damaged file becomes an error row
                    rows.append((name, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")
