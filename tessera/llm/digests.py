"""What SQL can say of operators that it cannot express as a whole: some of their result columns, as queries of their own.

Each query takes its rows from the operator; the SQL computes the same columns from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import op5_order_minhash
from .pii import op8_pii
from .quality import op7_quality
from .secrets import op9_secrets
from .tokens import op2_token_counts


def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_token_counts(spark, sf_dir).selectExpr("doc_id", "n_bytes", "(n_bytes > 0) = (n_tokens > 0) AS sound")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_order_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality(spark, sf_dir).selectExpr("doc_id", "held_out", "score BETWEEN 0 AND 1 AND predicted = cast(score >= 0.5 AS int) AS sound")


def personal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pii(spark, sf_dir).drop("spans")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_secrets(spark, sf_dir).drop("spans")


def _matches(kind: str, pos: int, pattern: str) -> str:
    """Rows (doc_id, kind, pos, start, stop, value) of the leftmost matches of a pattern, which has no groups."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {pos} AS pos, before + gap AS start, before + gap + length(value) AS stop, value FROM (
        SELECT doc_id, value, gap, coalesce(sum(gap + length(value)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
        SELECT doc_id, i, found[i] AS value, length(gaps[i]) AS gap FROM (SELECT doc_id, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{quoted}') AS found, string_split_regex(t, '{quoted}') AS gaps FROM docs WHERE regexp_matches(t, '{quoted}')))))"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_LUHN = """list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INT
    WHEN digits[i]::INT > 4 THEN 2 * digits[i]::INT - 9 ELSE 2 * digits[i]::INT END)) % 10 = 0"""
_NUMBER = "regexp_replace(value, '[^0-9]', '', 'g')"
_DOCS = "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _digest(spans: str, kinds: list[str], order: str) -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in kinds)
    return f"""{_DOCS}, spans AS MATERIALIZED ({spans}),
        told AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {order}) AS joined FROM spans GROUP BY doc_id)
        SELECT docs.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in kinds)}, sha256(coalesce(joined, '')) AS base_sha256 FROM docs LEFT JOIN told ON docs.doc_id = told.doc_id"""


_PERSONAL = " UNION ALL ".join(
    (
        _matches("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        "SELECT * FROM (" + _matches("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)") + ") WHERE len(list_filter(string_split(value, '.'), lambda p: p::HUGEINT > 255)) = 0",
        "SELECT * EXCLUDE digits FROM (SELECT *, " + _NUMBER + " AS digits FROM (" + _matches("card", 2, r"[0-9](?:[\x20-]?[0-9])+") + ")) WHERE length(digits) BETWEEN 13 AND 19 AND " + _LUHN,
        "SELECT * FROM (" + _matches("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]") + ") WHERE length(" + _NUMBER + ") BETWEEN 9 AND 15",
    )
)
_ASSIGN = "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?"""
_SECRET = " UNION ALL ".join(
    (
        "SELECT * FROM (" + _matches("assign", 0, _ASSIGN + "[A-Za-z0-9+/_.=-]+") + ") WHERE length(regexp_replace(value, '^" + _ASSIGN.replace("'", "''") + "', '')) >= 6",
        "SELECT * FROM (" + _matches("access", 1, "AKIA[A-Z0-9]+") + ") WHERE length(value) >= 20",
        "SELECT * FROM (" + _matches("hex", 2, "[0-9a-f]+") + ") WHERE length(value) >= 24",
    )
)
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
    list_reduce([xor(crc, byte), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

QUERIES = {f.__name__: f for f in (text_sizes, edited_texts, quality_folds, personal_base, secret_base)}
ORACLE_SQL = {
    "text_sizes": "SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, true AS sound FROM documents",
    "edited_texts": """SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 4) || substr(next, 1, n // 4)) AS edited_sha256 FROM (
        SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS next FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "quality_folds": f"SELECT doc_id, xor({_CRC}, 4294967295::BIGINT) % 3 = 1 AS held_out, true AS sound FROM documents",
    "personal_base": _digest(_PERSONAL, ["email", "ip", "card", "phone"], "pos, start"),
    "secret_base": _digest(_SECRET, ["assign", "access", "hex"], "start, pos"),
}
