"""Identity hashes and deterministic ids as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 4122 URL namespace (fixed value).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def offer_uid(source_key: Column, external_key: Column) -> Column:
    """First 32 hex digits of sha256 over ``source:external``."""
    return F.substring(F.sha2(F.concat_ws(":", source_key, external_key), 256), 1, 32)


def canonical_hash(columns: Sequence[str]) -> Column:
    """Fingerprint of a row: alphabetical JSON with nulls kept."""
    fields = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def _with_version(digest: Column, version: str) -> Column:
    """Lay 32 hex digits out as a uuid with the version and variant nibbles set."""
    variant = F.element_at(
        F.array(F.lit("8"), F.lit("9"), F.lit("a"), F.lit("b")),
        (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1,
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-" + version),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def uuid5(name: Column, namespace_hex: str = NAMESPACE_URL) -> Column:
    seed = F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8"))
    return _with_version(F.sha1(seed), "5")


def uuid4_from(name: Column) -> Column:
    """A deterministic id in v4 layout, for contracts that require that nibble."""
    return _with_version(F.sha2(name, 256), "4")


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 out of two nested digests, no UDF."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in raw).hex()
    outer = bytes(b ^ 0x5C for b in raw).hex()
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def cache_key(*parts: Column) -> Column:
    """sha256 over the parts, each followed by the unit separator."""
    return F.sha2(F.concat(*[F.concat(p, F.lit("\x1f")) for p in parts]), 256)
