"""Queries of this subpackage for __spark_entry__.py, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import table
from .decontamination import contaminated_documents
from .exact_dedup import exact_duplicates
from .html_text import extract_pages
from .language_id import held_out, identify
from .merkle import merkle_manifest
from .near_dedup import near_duplicates
from .pii import replace_pii
from .pitman_yor import score_documents
from .secrets import KINDS, scan_secrets
from .sharding import shard_documents
from .url_filter import filter_urls
from .whitening import whiten_embeddings

#: The URL rules of op4.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
TOKENIZER = "word_bpe_49k.json"
#: Setting with the key of the surrogates; where it is unset each call of the query draws a new key, so that none stands in the code.
PII_KEY = "spark.lexmill.pii.key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return replace_pii(docs, spark.conf.get(PII_KEY, None) or token_hex(32))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 8)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES))).alias("r")).select("r.*")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), ~held_out("doc_id", 10))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_language, op3_sharding, op4_urls, op5_exact, op6_near, op7_html, op8_benchmark, op9_secrets, op10_bpe, op11_pitman_yor,
                              op12_whitening, op13_merkle)
}



def _framed(c: str, text: bool = False) -> str:
    v = c if text else f"CAST({c} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v}, '-')"


def _crc32(c: str) -> str:
    """SQL of the CRC-32 of a text of ASCII characters, a byte at a time by the usual table."""
    steps = ", ".join(str(_crc_entry(i)) for i in range(256))
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({c}, ''), lambda x: CAST(ascii(x) AS BIGINT))), "
            f"lambda a, x: xor(a >> 8, list_extract([{steps}], CAST((xor(a, x) & 255) + 1 AS BIGINT)))), 4294967295)")


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


def merkle_sql(levels: int = 8, upper: int = 3) -> str:
    """SQL of op13, one step a level: for up to 8 ** levels rows of a language and 8 ** upper languages."""
    whole = lambda text: "sha256(" + " || ".join([_framed("doc_id"), _framed("source"), _framed("lang"), _framed("n_chars"), _framed(text, True)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # f: the folded digest, p: the proof so far, h: the digest of the node above the leaf, i: its place among n.
    sql = [f"""d AS (SELECT doc_id, lang, {whole('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {whole(lower)} ELSE {whole('text')} END AS start FROM documents),
        l AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
              dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) AS t FROM d),
        c0 AS (SELECT r, t, i, n, leaf AS h, start AS f, '' AS p FROM l)"""]

    def step(new: str, old: str) -> str:
        nodes = f"{new}n AS (SELECT t, i, n, any_value(h) AS h FROM {old} GROUP BY t, i, n)"
        runs = f"{new}r AS (SELECT t, i // 8 AS u, list(h ORDER BY i) AS run FROM {new}n WHERE n > 1 GROUP BY 1, 2)"
        s = "CAST(i % 8 AS INT)"
        return f"""{nodes}, {runs}, {new} AS (SELECT r, t, CASE WHEN n > 1 THEN i // 8 ELSE i END AS i, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END AS n,
            CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE h END AS h,
            CASE WHEN n > 1 THEN sha256(array_to_string(run[1:{s}], '') || f || array_to_string(run[{s} + 2:], '')) ELSE f END AS f,
            CASE WHEN n > 1 THEN p || array_to_string(run[1:{s}], '') || array_to_string(run[{s} + 2:], '') ELSE p END AS p
            FROM (SELECT o.*, q.run FROM {old} o LEFT JOIN {new}r q ON o.t = q.t AND o.i // 8 = q.u))"""

    sql += [step(f"c{k}", f"c{k - 1}") for k in range(1, levels + 1)]
    sql.append(f"e0 AS (SELECT r, 0 AS t, t - 1 AS i, (SELECT count(DISTINCT t) FROM l) AS n, h, f, p FROM c{levels})")
    sql += [step(f"e{k}", f"e{k - 1}") for k in range(1, upper + 1)]
    return f"""WITH {", ".join(sql)} SELECT l.doc_id, l.leaf, s.h AS subroot, e.h AS root, sha256(e.p) AS proof_sha256, e.f AS folded_root, e.f = e.h AS verified
        FROM l JOIN e{upper} e USING (r) JOIN c{levels} s USING (r)"""


_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op4_urls": f"""
        WITH p AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        q AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
        m AS (SELECT page_id, host, path, h || p AS rule, v, length(h || p) AS n
              FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, arg_max(rule, n) AS rule, coalesce(arg_max(v, n), 'allow') AS verdict FROM m GROUP BY page_id, host, path""",
    "op5_exact": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op13_merkle": merkle_sql(),
}
