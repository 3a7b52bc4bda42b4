"""Reproducible pseudo-random numbers from keys.

A draw is the leading 60 bits of the MD5 of key and salts (seed, repetition, draw), so it depends on nothing else, survives
task retries, and any SQL engine can repeat it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 15
BITS = 4 * DIGITS
# A double holds 53 bits: 52 of the hash and the half that keeps 0 and 1 out.
UNIFORM_BITS = 52


def key_hash(key: Column, *salts: Column | int) -> Column:
    """60-bit hash of a key under any number of salts (seed, repetition, draw); a NULL key is a key of its own."""
    return _leading(DIGITS, key, *salts)


def _leading(digits: int, key: Column, *salts: Column | int) -> Column:
    text = lambda x: F.coalesce(x.cast("long").cast("string"), F.lit("null"))
    parts = [text(key), *[text(s if isinstance(s, Column) else F.lit(s)) for s in salts]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("long")


def portable_hash(key: int, *salts: int) -> int:
    """Driver-side twin of :func:`key_hash` for small plans."""
    return int(hashlib.md5("|".join(str(x) for x in (key, *salts)).encode()).hexdigest()[:DIGITS], 16)


def hash_prefix(h: Column, bits: int) -> Column:
    """The leading ``bits`` bits of a hash, which rise with it."""
    return F.shiftright(h, BITS - bits)


def uniform(h: Column) -> Column:
    """A hash as a number strictly between 0 and 1."""
    return (hash_prefix(h, UNIFORM_BITS) + F.lit(0.5)) / F.lit(float(1 << UNIFORM_BITS))


def index(h: Column, n: Column | int) -> Column:
    """A hash as an index in [0, n)."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.least(F.floor(uniform(h) * size).cast("long"), size.cast("long") - 1)


def key_index(key: Column, n: int, *salts: Column | int) -> Column:
    """``index(key_hash(key, *salts), n)`` as a column that is never null, so that a join on it does not hash twice.

    For a power of two the index is the hash's leading bits, and its first digits are enough.
    """
    bits = n.bit_length() - 1
    if n == 1 << bits and 0 < bits <= UNIFORM_BITS:
        digits = -(-bits // 4)
        out = F.shiftright(_leading(digits, key, *salts), 4 * digits - bits)
    else:
        out = index(key_hash(key, *salts), n)
    return F.coalesce(out, F.lit(0).cast("long"))
