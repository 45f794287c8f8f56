"""Canonical JSON, content addresses and chain hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT, RECORD = b"\x1f", b"\x1e"


def sha256_json(value: Column) -> Column:
    """SHA-256 of a struct's compact JSON in declared order; null fields are left out."""
    return F.sha2(F.to_json(value), 256)


def hash_canonical(value: object) -> str:
    """SHA-256 of a JSON value with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def u64_le(c: Column) -> Column:
    """A non-negative long as 8 little-endian bytes."""
    return F.reverse_bytes(c) if hasattr(F, "reverse_bytes") else F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(c), 16, "0"), F.lit("(..)"), 1)), ""))


def ledger_identity(seq: Column, kind_json: Column) -> Column:
    """sha256(seq as 8 little-endian bytes || JSON of the record's kind)."""
    return F.sha2(F.concat(u64_le(seq), F.encode(kind_json, "UTF-8")), 256)


def chain(previous: Column, digest: Column) -> Column:
    """sha256(previous hex || digest hex)."""
    return F.sha2(F.concat(previous, digest), 256)


def check_hash(check: Column) -> Column:
    return sha256_json(check)


def verdict_id(run_id: Column, diff_hash: Column, checkspec_hash: Column, closure: Column, check_hashes: Column) -> Column:
    """sha256 of the newline-joined parts, an absent one as ''."""
    none = F.lit("")
    return F.sha2(F.array_join(F.concat(F.array(run_id, F.coalesce(diff_hash, none), checkspec_hash, F.coalesce(closure, none)), check_hashes), "\n"), 256)


@F.pandas_udf(T.StringType())
def content_tag(text: pd.Series) -> pd.Series:
    """FNV-1a 64 over lines without trailing blanks, each closed by a newline, as 16 upper-case hex digits."""
    return text.map(lambda t: None if t is None else f"{fnv1a64(b''.join(line.rstrip(' \t').encode() + b'\n' for line in t.split('\n'))):016X}")


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def context_hash(text: str) -> str:
    """Two 64-bit lanes as 32 hex digits: FNV-1a, and one over rotated bytes with its own start and prime."""
    high = 0x9E3779B97F4A7C15
    for b in text.encode():
        high = (high ^ ((b << 1 | b >> 7) & 255)) * 0x1000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{high:016x}{fnv1a64(text.encode()):016x}"


def snapshot_digest(rows: list[tuple[str, str, int]]) -> str:
    """Digest of a catalog: sorted (root, path, size) rows with unit and record separators."""
    return hashlib.sha256(b"".join(r.encode() + UNIT + p.encode() + UNIT + n.to_bytes(8, "little") + RECORD for r, p, n in sorted(rows))).hexdigest()


def toolchain_digest(tools: dict[str, str], lockfiles: dict[str, str]) -> str:
    parts = [b"tool" + UNIT + k.encode() + UNIT + v.encode() + RECORD for k, v in sorted(tools.items())]
    parts += [b"lock" + UNIT + k.encode() + UNIT + v.encode() + RECORD for k, v in sorted(lockfiles.items())]
    return hashlib.sha256(b"".join(parts)).hexdigest()


def dsse_pae(payload_type: Column, body: Column) -> Column:
    """DSSE pre-authentication encoding, with byte lengths."""
    return F.concat(F.lit("DSSEv1 "), F.octet_length(payload_type).cast("string"), F.lit(" "), payload_type, F.lit(" "), F.octet_length(body).cast("string"), F.lit(" "), body)
