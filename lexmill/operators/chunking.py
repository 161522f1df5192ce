"""Chunks with overlap and their coverage map."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on.
HEADER = re.compile(r"EMENTA|RELAT[ÓO]RIO|VOTO|DISPOSITIVO|DECIS[ÃA]O|AC[ÓO]RD[ÃA]O|FUNDAMENTA[ÇC][ÃA]O")
PREAMBLE = "PREAMBULO"
MARKERS = (". ", ".\n", "! ", "?\n", "\n")


def estimate_tokens(text: str) -> int:
    """Four characters to a token; a tokenizer can be passed instead."""
    return -(-len(text) // 4)


class Unit(NamedTuple):
    start: int
    end: int
    tokens: int
    section: str


def cuts(body: str, size: int, reach: int = 200) -> list[int]:
    """Ends of the pieces of an oversize paragraph: `size` characters on, or after the first kind of marker that lies within reach of there."""
    ends, at = [], 0
    while at < len(body):
        end = at + size
        found = next((i + len(m) for m in MARKERS if (i := body.find(m, end, min(end + reach, len(body)))) >= 0), end) if end < len(body) else len(body)
        ends.append(found)
        at = found
    return ends


def units(text: str, max_tokens: int, count=estimate_tokens) -> list[Unit]:
    """Paragraphs, parted by blank lines, with the section whose header was the first line of one of them last; oversize ones in pieces."""
    out, section = [], PREAMBLE
    for m in re.finditer(r"\S[\s\S]*?(?=\n\s*\n|\Z)", text):
        body = m.group().rstrip()
        head = body.splitlines()[0].strip().upper()
        if HEADER.fullmatch(head):
            section = head
        total = count(body)
        pieces = [len(body)] if total <= max_tokens else cuts(body, max(200, int(max_tokens * len(body) / max(1, total) * 0.9)))
        for a, b in zip([0, *pieces], pieces, strict=False):
            if piece := body[a:b].strip():
                out.append(Unit(m.start() + a, m.start() + b, count(piece), section))
    return out


def pack(text: str, max_tokens: int = 25_000, overlap: int = 500, count=estimate_tokens) -> list[tuple[list[Unit], int]]:
    """Units packed greedily into chunks, each with the number of units it repeats from the chunk before."""
    chunks, current, used, repeated = [], [], 0, 0
    for u in units(text, max_tokens, count):
        if current and used + u.tokens > max_tokens:
            chunks.append((current, repeated))
            back, size = [], 0
            for v in reversed(current):
                if size + v.tokens > overlap:
                    break
                back.insert(0, v)
                size += v.tokens
            while back and size + u.tokens > max_tokens:
                size -= back.pop(0).tokens
            current, used, repeated = back, size, len(back)
        current = [*current, u]
        used += u.tokens
    return [*chunks, (current, repeated)] if len(current) > repeated or not chunks and current else chunks


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, max_tokens: int = 25_000, overlap: int = 500) -> DataFrame:
    """(doc_id, chunk, start, end, tokens, overlap_units, sections, text) of every text; blank texts have no chunk."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(doc, i, own[0].start, own[-1].end, sum(u.tokens for u in own), repeated, list(dict.fromkeys(u.section for u in own if u.section)),
                     "\n\n".join(text[u.start : u.end] for u in own))
                    for doc, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True) if text for i, (own, repeated) in enumerate(pack(text, max_tokens, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "tokens", "overlap_units", "sections", "text"])

    return docs.select(id_col, text_col).mapInPandas(run, f"doc_id {kind}, chunk long, start long, end long, tokens long, overlap_units long, sections array<string>, text string")


def coverage(chunks: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Share of each document's characters that chunks cover, from the chunks' ends (they overlap in order), to four places."""
    spans = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("s", zero, lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n")))["n"]
    size = docs.select(F.col(id_col).alias("doc_id"), F.length(text_col).alias("size"))
    return size.join(spans, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"),
                                                    F.round(F.coalesce(F.try_divide(covered, F.col("size")), F.lit(0.0)), 4).alias("coverage"))
