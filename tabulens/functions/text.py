"""Text hygiene on string columns: control characters, credential masking, safe identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Credential shapes in the order they are masked, and their replacements.
CREDENTIAL_MASKS = [
    (r"AIza[0-9A-Za-z\-_]{35}", "[REDACTED_GEMINI_KEY]"),
    (r"sk-[0-9A-Za-z\-_]{20,}", "[REDACTED_OPENAI_KEY]"),
    (r"ant-[0-9A-Za-z\-_]{20,}", "[REDACTED_ANTHROPIC_KEY]"),
    (r"(?i)(Bearer\s+)[A-Za-z0-9\-_.]+", "$1[REDACTED_TOKEN]"),
    (r"(?i)((?:key|api_key|apikey|token|secret)=)[A-Za-z0-9\-_.]+", "$1[REDACTED]"),
    (r"(?i)((?:x-api-key|x-goog-api-key|authorization):\s*)[^\s,]+", "$1[REDACTED]"),
]


def mask_credentials(c: Column) -> Column:
    """Replace API keys, bearer tokens, ``key=`` parameters and auth headers."""
    for pattern, replacement in CREDENTIAL_MASKS:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def sanitize_text(c: Column, max_length: int | None = None) -> Column:
    """Drop unprintable characters but newline, tab and return; strip; ``max_length`` cuts the rest."""
    unprintable = r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}\p{Zl}\p{Zp}&&[^\n\t\r]]|[\p{Zs}&&[^ ]]"
    cleaned = F.regexp_replace(c, unprintable, "")
    whole = F.regexp_replace(cleaned, r"^\s+|\s+$", "")
    return F.coalesce(whole if max_length is None else F.substring(whole, 1, max_length), F.lit(""))


def is_safe_identifier(c: Column) -> Column:
    """Letters, digits, ``_``, ``-`` and ``.`` only, without ``..``."""
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9_\-.]+$") & ~c.contains(".."), F.lit(False))
