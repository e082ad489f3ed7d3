"""Column-level protection of personal data.

AES-GCM through Spark's built-in ``aes_encrypt``/``try_aes_decrypt``; the
ciphertext is base64 text so it fits a string column.  Null and blank values
pass through unchanged; text that does not decrypt is returned as it is,
like the reference (so plain legacy rows survive a decrypting read).

The key enters a query as a scalar subquery over a one-row table, never as a
literal, so it is in no plan, ``explain`` output or event log; the name of its
setting matches Spark's default redaction pattern.

With a key ring every protected value names its key (``enc:<id>:<base64>``), so
keys can be changed: new values take the ring's current key, old ones stay
readable and ``rotate`` moves them.  ``blind_index`` is a keyed digest (HMAC
SHA-256) of a value: equal values have equal digests under every key of the ring,
so protected rows can be grouped and joined without decrypting them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

KEY_CONF = "spark.shopfloor.pii.secret"


def key_column(spark: SparkSession, key: str) -> Column:
    """A 16/24/32-byte key as a column that doesn't show it."""
    return spark.createDataFrame([(key,)], "k string").scalar()


def pii_key(spark: SparkSession) -> Column:
    """The key from the session's configuration; it is an error if none is
    set, since data written under a made-up key could never be read."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        raise RuntimeError(f"{KEY_CONF} is not set: personal data can't be protected without a key")
    return key_column(spark, key)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def protect(c, key: Column) -> Column:
    s = _c(c)
    enc = F.base64(F.aes_encrypt(s.cast("binary"), key.cast("binary"), F.lit("GCM")))
    return F.when(s.isNull() | (s == ""), s).otherwise(enc)


def unprotect(c, key: Column) -> Column:
    s = _c(c)
    raw = F.try_aes_decrypt(F.try_to_binary(s, F.lit("base64")), key.cast("binary"), F.lit("GCM"))
    return F.when(s.isNull() | (s == ""), s).otherwise(F.coalesce(raw.cast("string"), s))


PREFIX = "enc:"
_HMAC_BLOCK = 64


def ring_column(spark: SparkSession, keys: dict[str, str], current: str, index_key: str) -> Column:
    """A key ring as a column that doesn't show its keys: ``keys`` by id (each of 16, 24 or 32
    bytes), the id that protects new values, and the key of the blind index."""
    if current not in keys or not all(re.fullmatch("[A-Za-z0-9_-]+", k) for k in keys):
        raise ValueError("the current key must be in the ring, and ids be of letters, digits, _ and -")
    secret = index_key.encode()
    if not 16 <= len(secret) <= _HMAC_BLOCK:
        raise ValueError(f"the index key must have 16 to {_HMAC_BLOCK} bytes")
    pad = lambda b: bytes(x ^ b for x in secret.ljust(_HMAC_BLOCK, bytes(1)))
    row = ((current, keys, bytearray(pad(0x36)), bytearray(pad(0x5C))),)
    return spark.createDataFrame([row], "ring struct<current:string,keys:map<string,string>,inner:binary,outer:binary>").scalar()


def protect_with(c, ring: Column) -> Column:
    """``c`` under the ring's current key; null and blank stay."""
    s = _c(c)
    key = F.try_element_at(ring["keys"], ring["current"])
    enc = F.base64(F.aes_encrypt(s.cast("binary"), key.cast("binary"), F.lit("GCM")))
    return F.when(s.isNull() | (s == ""), s).otherwise(F.concat(F.lit(PREFIX), ring["current"], F.lit(":"), enc))


def _plain(s: Column, ring: Column) -> Column:
    """The value under a protected text; null if it isn't one, or none of this ring."""
    parts = F.split(s, ":", 3)
    key = F.try_element_at(ring["keys"], parts[1]).cast("binary")
    raw = F.try_aes_decrypt(F.try_to_binary(parts[2], F.lit("base64")), key, F.lit("GCM"))
    return F.when(s.rlike("^enc:[A-Za-z0-9_-]+:."), raw.cast("string"))


def unprotect_with(c, ring: Column) -> Column:
    """The value of ``c``; what is not protected, or under a key that the ring lacks, stays."""
    s = _c(c)
    return F.coalesce(_plain(s, ring), s)


def rotate(c, ring: Column) -> Column:
    """``c`` under the current key: values under another key of the ring are protected anew,
    plain ones for the first time, and those under a key that the ring lacks stay."""
    s = _c(c)
    now = F.startswith(s, F.concat(F.lit(PREFIX), ring["current"], F.lit(":")))
    plain = _plain(s, ring)
    return (F.when(now & plain.isNotNull(), s).when(plain.isNotNull(), protect_with(plain, ring))
            .when(s.rlike("^enc:[A-Za-z0-9_-]+:."), s).otherwise(protect_with(s, ring)))


def blind_index(c, ring: Column) -> Column:
    """HMAC SHA-256 of a plain value in hex; null and blank stay, so that blank is a value of its own."""
    s = _c(c)
    inner = F.unhex(F.sha2(F.concat(ring["inner"], s.cast("binary")), 256))
    return F.when(s.isNull() | (s == ""), s).otherwise(F.sha2(F.concat(ring["outer"], inner), 256))
