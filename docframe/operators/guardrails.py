"""Deterministic checks on messages and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docframe.functions.text import lit, strip

# Limits, patterns, reasons and replacement texts of the checks.
MAX_CHARS = 8000
MAX_PAPERS = 8
MAX_IMAGE_BYTES = 2 * 1024 * 1024
MIN_SECRET_CHARS = 8
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
EXFILTRATION = (
    (
        r"(?is)\b(?:ignore|disregard|forget)\b.{0,40}\b(?:previous|above|system)\b"
        r".{0,40}\b(?:instructions?|prompt|rules?)\b",
        "Message attempts to override system instructions.",
    ),
    (
        r"(?is)\b(?:reveal|show|print|dump|exfiltrate|leak)\b.{0,40}\b"
        r"(?:system\s*prompt|hidden\s*prompt|developer\s*message|api[_\s-]?key|secret|token|password)\b",
        "Message requests system or secret material.",
    ),
    (
        r"(?is)\b(?:repeat|output|display)\b.{0,30}\b(?:your|the)\b.{0,20}"
        r"\b(?:system\s*prompt|initial\s*instructions?)\b",
        "Message requests system prompt disclosure.",
    ),
    (
        r"(?is)\b(?:[A-Z][A-Z0-9_]{0,60}_API_KEY|DATABASE_URL)\b\s*[:=]",
        "Message contains credential assignment patterns.",
    ),
)
ACTIVE_HTML = (
    r"(?is)<script\b[^>]*>.*?</script>|</?\s*(?:iframe|object|embed|link|meta|base|form)\b[^>]*>"
    r"|javascript\s*:|vbscript\s*:|on(?:error|load|click|mouse\w+|focus|blur|submit|input)\s*="
)
QUOTED_HANDLER = r"""(?i)\son[a-z]+\s*=\s*(['"]).*?\1"""
BARE_HANDLER = r"(?i)\son[a-z]+\s*=\s*[^\s>]+"
IMAGE_URL = r"(?i)^data:(image/(?:png|jpeg|jpg|webp|gif));base64,([A-Za-z0-9+/=\s]+)$"
GROUNDED_KINDS = "('paper_answer', 'comparison', 'research_report')"
UNGROUNDED_NOTE = "grounded_flag_cleared_missing_evidence"
REDACTED, REMOVED = "[REDACTED]", "[removed]"


def exfiltration_reason(c: str) -> str:
    """Reason of the first matching pattern, else null."""
    return "CASE " + " ".join(f"WHEN {c} RLIKE {lit(p)} THEN {lit(r)}" for p, r in EXFILTRATION) + " END"


def image_code(url: str, max_bytes: int = MAX_IMAGE_BYTES) -> str:
    """Rejection code of an image data URL, else null (G1)."""
    raw = strip(url)
    payload = f"regexp_replace(regexp_extract({raw}, {lit(IMAGE_URL)}, 2), '\\\\s+', '')"
    # Standard base64 with full padding; the decoder itself would accept more.
    valid = f"({payload} RLIKE '^[A-Za-z0-9+/]*={{0,2}}$' AND length({payload}) % 4 = 0)"
    size = f"octet_length(try_to_binary({payload}, 'base64'))"
    return f"""CASE WHEN NOT startswith(lower({raw}), 'data:') THEN 'invalid_image'
        WHEN NOT {raw} RLIKE {lit(IMAGE_URL)} THEN 'invalid_image_mime'
        WHEN NOT {valid} OR {size} IS NULL THEN 'invalid_image_base64'
        WHEN {size} > {max_bytes} THEN 'image_too_large' WHEN {size} = 0 THEN 'empty_image' END"""


def _known_secrets(secrets: Sequence[str]) -> list[str]:
    return [s.strip() for s in secrets if s and len(s.strip()) >= MIN_SECRET_CHARS]


def validate_messages(df: DataFrame, secrets: Sequence[str] = ()) -> DataFrame:
    """Add ``code``: the first failed check, or null (G1).

    Columns: ``message, selected_papers, image_data_url``; further columns pass through.
    """
    secret = " OR ".join(f"contains(__m, {lit(s)})" for s in _known_secrets(secrets)) or "false"
    code = f"""CASE WHEN __m = '' AND coalesce(image_data_url, '') = '' THEN 'empty_message'
        WHEN length(__m) > {MAX_CHARS} THEN 'message_too_long'
        WHEN __m RLIKE {lit(CONTROL)} THEN 'control_characters'
        WHEN coalesce(size(array_distinct(selected_papers)), 0) > {MAX_PAPERS} THEN 'too_many_papers'
        WHEN {exfiltration_reason('__m')} IS NOT NULL THEN 'exfiltration_pattern'
        WHEN {secret} THEN 'secret_in_input'
        WHEN coalesce(image_data_url, '') <> '' THEN {image_code('image_data_url')} END"""
    message = strip("coalesce(message, ' ')")
    return df.selectExpr("*", f"{message} AS __m").selectExpr(
        *df.columns, f"{code} AS code"
    )


def redact_secrets(c: str, secrets: Sequence[str]) -> str:
    """Every known secret replaced."""
    out = f"coalesce({c}, '')"
    for s in _known_secrets(secrets):
        out = f"replace({out}, {lit(s)}, '{REDACTED}')"
    return out


def sanitize_html(c: str) -> str:
    """Script blocks, dangerous tags and handlers neutralised."""
    out = f"regexp_replace({c}, {lit(ACTIVE_HTML)}, '{REMOVED}')"
    return f"regexp_replace(regexp_replace({out}, {lit(QUOTED_HANDLER)}, ''), {lit(BARE_HANDLER)}, '')"


def demote_ungrounded(df: DataFrame) -> DataFrame:
    """Clear ``grounded`` where neither citations nor a grounding artifact back it."""
    bare = (
        "(grounded AND coalesce(size(citations), 0) <= 0 AND "
        f"NOT coalesce(exists(artifacts, a -> a.kind IN {GROUNDED_KINDS}), false))"
    )
    notes = "coalesce(guardrail_notes, CAST(array() AS array<string>))" if "guardrail_notes" in df.columns else "CAST(array() AS array<string>)"
    rest = [c for c in df.columns if c not in ("grounded", "guardrail_notes")]
    return df.selectExpr(
        *rest, f"grounded AND NOT {bare} AS grounded",
        f"IF({bare}, array_append({notes}, '{UNGROUNDED_NOTE}'), {notes}) AS guardrail_notes",
    )


def _scrub(value: str, dtype: T.DataType, secrets: Sequence[str], depth: int = 0) -> str:
    if isinstance(dtype, T.StringType):
        return f"IF({value} IS NULL, NULL, {sanitize_html(redact_secrets(value, secrets))})"
    var = f"v{depth}"
    if isinstance(dtype, T.ArrayType):
        return f"transform({value}, {var} -> {_scrub(var, dtype.elementType, secrets, depth + 1)})"
    if isinstance(dtype, T.MapType):
        return f"transform_values({value}, (k{depth}, {var}) -> {_scrub(var, dtype.valueType, secrets, depth + 1)})"
    if isinstance(dtype, T.StructType):
        fields = ", ".join(f"'{f.name}', {_scrub(f'{value}.`{f.name}`', f.dataType, secrets, depth)}" for f in dtype)
        return f"IF({value} IS NULL, NULL, named_struct({fields}))"
    return value


def scrub_nested(df: DataFrame, columns: Sequence[str], secrets: Sequence[str] = ()) -> DataFrame:
    """Redact and sanitise every string inside the given columns, at any depth."""
    return df.selectExpr(
        *[
            f"{_scrub(f'`{f.name}`', f.dataType, secrets)} AS `{f.name}`" if f.name in columns else f"`{f.name}`"
            for f in df.schema
        ]
    )
