"""Deterministic groups, samples and cursors."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_group(key: Column, groups: int = 10) -> Column:
    """The SHA-256 of the text as a number, modulo `groups` (below 2^31), by 15 hex digits at a time. The hash is made once a row."""

    def of(text: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for at in range(0, 64, 15):
            n = min(15, 64 - at)
            part = F.conv(F.substr(text, F.lit(at + 1), F.lit(n)), 16, 10).cast("bigint")
            out = (out * (16**n % groups) + part % groups) % groups
        return out.cast("int")

    return F.get(F.transform(F.array(F.sha2(key.cast("string").cast("binary"), 256)), of), F.lit(0))


def sampled(modulus: int, *keys: str) -> Column:
    """One in `modulus` rows, by a hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(modulus)) == 0


def cursor(**values) -> str:
    """An opaque page cursor."""
    return base64.urlsafe_b64encode(json.dumps(values, sort_keys=True).encode()).decode().rstrip("=")


def from_cursor(text: str, **kinds: type) -> dict:
    """The values of a cursor, of the kinds asked for; ValueError where it is not one."""
    try:
        values = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        return {name: kind(values[name]) for name, kind in kinds.items()}
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("not a page cursor") from error
