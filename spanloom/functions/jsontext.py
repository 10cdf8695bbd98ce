"""Checks and clean-up on raw JSON text, without parsing it into a schema."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanloom.config import SECRET_KEYS, SENSITIVE_KEY_FRAGMENTS
from spanloom.functions.text import strip

# --------------------------------------------------------------------------
# Credential patterns in free text and the limit of a message.
# --------------------------------------------------------------------------
BEARER = r"(?i)(bearer\s+)[^\s,;]+"
CREDENTIAL = r"(?i)((?:api[_-]?key|authorization|token|secret|password)\s*[:=]\s*)[^\s,;\"']+"
REDACTED = "[redacted]"
MESSAGE_LIMIT = 600


def is_object(line: Column) -> Column:
    """Valid JSON whose top level is an object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))


def is_valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def missing_fields(line: Column, required: Sequence[str]) -> Column:
    """Required keys that a JSON object lacks; a key with a null value is present."""
    wanted = F.array(*[F.lit(name) for name in required])
    return F.array_except(wanted, F.json_object_keys(line))


def field_type(line: Column, name: str) -> Column:
    """JSON type of a top-level field: STRING, BIGINT, VOID for null, and so on."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(line), f"$.{name}", "variant"))


def object_keys_deep(line: Column) -> Column:
    """Every object key at any depth, in text order.

    Escaped quotes and backslashes are neutralised first, so that a quote
    always ends a string; the other escapes of a key are decoded.
    """
    flat = F.regexp_replace(line, r'\\(["\\])', r"\\u0001")
    raw = F.regexp_extract_all(flat, F.lit(r'"([^"]*)"(\s*:)?'), F.lit(0))
    keys = F.filter(raw, lambda s: s.endswith(":"))
    as_strings = F.transform(keys, lambda s: F.regexp_replace(s, r"\s*:$", ""))
    return F.from_json(
        F.concat(F.lit("["), F.array_join(as_strings, ","), F.lit("]")), "array<string>"
    )


def first_secret_key(line: Column) -> Column:
    """First key whose normalised name is a known credential field, else null."""

    def is_secret(key: Column) -> Column:
        return F.replace(F.lower(strip(key)), F.lit("-"), F.lit("_")).isin(*SECRET_KEYS)

    return F.get(F.filter(object_keys_deep(line), is_secret), F.lit(0))


def redact_text(text: Column) -> Column:
    """Blank out bearer tokens and `name: value` credentials."""
    once = F.regexp_replace(text, BEARER, "$1" + REDACTED)
    return F.regexp_replace(once, CREDENTIAL, "$1" + REDACTED)


def is_sensitive_key(key: Column) -> Column:
    low = F.lower(key)
    hit = F.lit(False)
    for fragment in SENSITIVE_KEY_FRAGMENTS:
        hit = hit | low.contains(fragment)
    return hit


def safe_message(text: Column) -> Column:
    """Redacted message cut to its limit; empty bodies give null."""
    clean = redact_text(text)
    return F.when(~clean.isin("", "{}", "[]", "null"), F.left(clean, F.lit(MESSAGE_LIMIT)))


# A quoted text, one punctuation mark, or what lies between: the tokens of a JSON text.
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^"{}\[\],:\s]+')


def _without_credentials(body: str) -> str:
    """One pass over the tokens: a value is left out from its key's colon to the comma or end at the key's depth."""
    out, depth, hidden, last = [], 0, None, ""
    for token in _TOKENS.findall(body):
        depth += (token in "{[") - (token in "}]")
        if hidden is not None:
            if (token == "," and depth == hidden) or (token in "}]" and depth < hidden):
                hidden = None
            else:
                continue
        out.append(f"{token} " if token in ",:" else token)
        if token == ":" and any(part in json.loads(last).lower() for part in SENSITIVE_KEY_FRAGMENTS):
            out.append(f'"{REDACTED}"')
            hidden = depth
        last = token
    return "".join(out)


@F.pandas_udf(StringType())
def _redacted(bodies: pd.Series) -> pd.Series:
    return bodies.map(_without_credentials, na_action="ignore")


def redact_body(body: Column) -> Column:
    """A JSON body with the value of every credential-like key replaced, however deep.

    White space outside texts comes out as one blank after `,` and `:`. Text that
    is not JSON passes through unchanged.
    """
    return F.when(is_valid(body), _redacted(F.when(is_valid(body), body))).otherwise(body)
