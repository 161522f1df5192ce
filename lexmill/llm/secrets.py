"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Candidates are long unbroken tokens.  Each gets an encoding from its characters and three
tests of randomness in it: chi-squared uniformity of its symbols, runs about the median
and lag-1 serial correlation.  A token that fails one of them isn't random.  The others get the chance that
prose of their length, by the corpus's own character counts, would score as the token does: in the chi-squared
statistic and in the likelihood of its characters under the random encoding; a token's p-value is the lesser of the two,
times two.  The Benjamini-Hochberg rule over the candidates of the whole corpus then picks the spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The base patterns, their kinds and the least length of what they must match.
BASE = {
    "assign": (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
RANDOM = "random"
KINDS = (*BASE, RANDOM)

#: A candidate: this many characters at least, of those that encodings use; = is padding at the end, else it splits tokens.
LEAST = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?")
#: Symbols of each encoding, in the order in which encodings are tried.
ENCODINGS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "LETTERS": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: A token fails a test of randomness at this level; with three tests 1 in 330 random tokens is lost.
TEST_LEVEL = 0.001
#: False-discovery rate, and the bins of -log10 p in which candidates are counted (p below 1e-50 shares the last).
FDR, BINS, BINS_PER_DECADE = 0.01, 1000, 20
#: Bounds of the character model: symbols without a count get this many.
FLOOR_COUNT = 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping for each kind, in code points."""
    out = []
    for kind, (pattern, group, least) in BASE.items():
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def encoding_of(token: str) -> str | None:
    """The first encoding with all of the token's symbols; padding doesn't count."""
    symbols = set(token.rstrip("="))
    return next((name for name, chars in ENCODINGS.items() if symbols <= set(chars)), None)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson-Hilferty)."""
    return normal_tail(((max(x, 0) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def randomness(token: str, encoding: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for a token that is random in its encoding."""
    chars = ENCODINGS[encoding]
    x = np.array([chars.index(c) for c in token.rstrip("=")], np.float64)
    n, k = len(x), len(chars)
    counts = np.bincount(x.astype(int), minlength=k)
    # With few symbols for each place the statistic's exact mean and variance under a uniform draw stand in for the limit's.
    stat = float(((counts - n / k) ** 2).sum() * k / n)
    spread = math.sqrt(2 * (k - 1) * (n - 1) / n)
    uniform = chi_squared_tail(stat, k - 1) if n >= 5 * k else normal_tail((stat - (k - 1)) / spread)
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = min(1.0, 2 * normal_tail(abs(runs - mean) / math.sqrt(var))) if var > 0 else 0.0
    d = x - x.mean()
    r = float((d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-9))
    serial = min(1.0, 2 * normal_tail(abs(r + 1 / n) * math.sqrt(n)))
    return uniform, p_runs, serial


def prose_p(token: str, encoding: str, model: dict[str, int]) -> float:
    """Chance that prose of this length, by the model's character counts, scores like the token in either of two statistics (Bonferroni):
    chi-squared uniformity, and the characters' likelihood under the encoding.  Runs and serial correlation have no say here: prose has them by chance or not, as its words fall."""
    chars = ENCODINGS[encoding]
    body = token.rstrip("=")
    # Prose writes a word in one case and without digits or signs: unseen symbols keep a small count.
    # Words in capitals are prose as well, so letters of one case have the counts of both.
    both = encoding in ("letters", "LETTERS")
    weights = np.array([max(model.get(c, 0) + both * model.get(c.swapcase(), 0), FLOOR_COUNT) for c in chars], np.float64)
    f = weights / weights.sum()
    x = np.array([chars.index(c) for c in body])
    n, k = len(x), len(chars)

    def tail(score: float, mean: float, var: float) -> float:
        return normal_tail((score - mean) / math.sqrt(var)) if var > 1e-12 else 1.0

    llr = np.log(1 / k) - np.log(f)
    mean = float((f * llr).sum())
    likely = tail(float(llr[x].mean()), mean, float((f * (llr - mean) ** 2).sum()) / n)
    # Moments of the sum of squared counts of n independent draws from f; the chi-squared statistic is linear in it.
    two, three = float((f**2).sum()), float((f**3).sum())
    squares = float((np.bincount(x, minlength=k) ** 2).sum())
    even = tail(-squares, -(n + n * (n - 1) * two), 2 * n * (n - 1) * two + 4 * n * (n - 1) * (n - 2) * three - 2 * n * (n - 1) * (2 * n - 3) * two**2)
    return min(1.0, 2 * min(likely, even))


def candidates(text: str, model: dict[str, int]) -> list[tuple[int, int, float]]:
    """(start, end, p) of the tokens that pass the battery; one of fewer than five different characters isn't tested."""
    out = []
    for m in _CANDIDATE.finditer(text):
        token = m.group()
        if len(set(token)) < 5:
            continue
        encoding = encoding_of(token)
        if encoding is None or min(randomness(token, encoding)) < TEST_LEVEL:
            continue
        out.append((m.start(), m.end(), prose_p(token, encoding, model)))
    return out


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(128, np.int64)
    for batch in batches:
        data = batch.column(0)
        for text in data:
            b = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            total += np.bincount(b, minlength=256)[:128]
    yield pa.RecordBatch.from_arrays([pa.array([chr(i) for i in range(128)]), pa.array(total)], ["c", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Counts of the 128 ASCII characters over all texts."""
    rows = docs.select(F.col(text_col)).mapInArrow(_char_counts, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {r["c"]: r["n"] for r in rows}


def _scan(model: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        scored = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bin", pa.int32())]))
        for batch in batches:
            base, more = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in base_spans(text)])
                more.append([{"start": a, "end": b, "bin": min(BINS, int(-math.log10(max(p, 1e-300)) * BINS_PER_DECADE))} for a, b, p in candidates(text, model)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(more, scored)], ["doc_id", "base", "candidates"])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, base array<struct<kind, start, end>>, spans array<same>) for every row of docs.

    base are the fixed patterns' spans, spans those and the method's of kind `random`; both by start, then kind in the
    order of KINDS.  Null and empty texts have none.  Null and repeated ids are rows like any other; other columns are not
    read; an empty table gives an empty result.  The driver sees 128 character counts and one count for each bin of p.
    """
    model = character_model(docs, text_col)
    doc_type = docs.schema[id_col].dataType.simpleString()
    found = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(
        _scan(model), f"doc_id {doc_type}, base array<struct<kind:string,start:long,end:long>>, candidates array<struct<start:long,end:long,bin:int>>"))
    counts = {r["bin"]: r["n"] for r in found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.bin").alias("bin")).agg(F.count("*").alias("n")).collect()}
    least, rank, total = BINS + 1, 0, sum(counts.values())
    for b in sorted(counts, reverse=True):
        rank += counts[b]
        if 10 ** (-b / BINS_PER_DECADE) <= fdr * rank / total:
            least = b
    random = F.transform(F.filter("candidates", lambda c: c["bin"] >= least),
                         lambda c: F.struct(F.lit(RANDOM).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    order = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.lit(list(KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", order(F.col("base")).alias("base"), order(F.concat("base", random)).alias("spans"))
