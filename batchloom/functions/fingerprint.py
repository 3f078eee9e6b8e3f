"""Content fingerprints of source rows."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_PREFIX = "__parse_error__"
NOT_AN_OBJECT = "Generation rows must be JSON objects."
PARSED = "struct<record:string,parse_error:string,record_fingerprint:binary>"


def canonical(value: object) -> str:
    """Sorted keys, no blanks, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse_line(line: str) -> dict[str, object]:
    """Record (its own JSON text), error and fingerprint of one line; an error is data."""
    try:
        value = json.loads(line)
        if not isinstance(value, dict):
            raise ValueError(NOT_AN_OBJECT)
        return {"record": line, "parse_error": None, "record_fingerprint": hashlib.sha256(canonical(value).encode("utf-8")).digest()}
    except (ValueError, RecursionError) as error:  # lone surrogates too
        raw = (ERROR_PREFIX + line).encode("utf-8", "surrogatepass")
        return {"record": None, "parse_error": str(error), "record_fingerprint": hashlib.sha256(raw).digest()}


def parse_strict(lines: str | Column) -> Column:
    """Strict parse of JSON lines, in Arrow batches: SQL's parsers accept trailing text and
    reformat numbers, so fingerprints would differ."""

    @F.pandas_udf(PARSED)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_line(x) for x in s], columns=["record", "parse_error", "record_fingerprint"])

    return run(lines)


def native(*columns: Column) -> Column:
    """Fingerprint of typed columns, without Python: SHA-256 of their JSON text."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256))


def text_fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)
