"""Replacement strategies beside the categories' own formats: functions of a value and its 64 hex digits of entropy."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .replace import DEMO_KEY, _fold, _pad, hmac_hex, replace

#: Letters to draw from (fixed values).
MIXED = string.ascii_lowercase + string.ascii_uppercase + string.digits
LOWER = string.ascii_lowercase + string.digits
#: Takes the place of a generator's state of zero (fixed value).
NONZERO = 0xDEADBEEFCAFEBABE - (1 << 64)
LOW32 = 0xFFFFFFFF


def _word(h: Column, i: int) -> Column:
    """The i-th 32-bit word of the hash, its bytes taken little end first."""
    turned = F.concat(*(F.substr(h, F.lit(8 * i + 2 * k + 1), F.lit(2)) for k in (3, 2, 1, 0)))
    return F.conv(turned, 16, 10).cast("long")


def seed(h: Column) -> Column:
    """The sum of the hash's four 64-bit words modulo 2**64, as a signed long; added in halves, as longs must not overflow."""
    low = _word(h, 0) + _word(h, 2) + _word(h, 4) + _word(h, 6)
    high = _word(h, 1) + _word(h, 3) + _word(h, 5) + _word(h, 7) + F.shiftright(low, 32)
    s = F.shiftleft(high.bitwiseAND(F.lit(LOW32)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW32)))
    return F.when(s == 0, F.lit(NONZERO)).otherwise(s)


def _step(s: Column) -> Column:
    s = s.bitwiseXOR(F.shiftleft(s, 13))
    s = s.bitwiseXOR(F.shiftrightunsigned(s, 7))
    return s.bitwiseXOR(F.shiftleft(s, 17))


def draw(h: Column, n: Column, letters: str) -> Column:
    """n letters by a 64-bit xorshift generator seeded with the hash."""
    size = len(letters)

    def add(acc: Column, _: Column) -> Column:
        return F.struct(_step(acc["s"]).alias("s"), F.concat(acc["t"], pick(_step(acc["s"]))).alias("t"))

    def pick(s: Column) -> Column:  # the remainder of s as an unsigned number
        rest = (F.shiftrightunsigned(s, 1) % size * 2 + s.bitwiseAND(F.lit(1).cast("long"))) % size
        return F.substr(F.lit(letters), (rest + 1).cast("int"), F.lit(1))

    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(seed(h).alias("s"), F.lit("").alias("t")), add, lambda acc: acc["t"])


def random_string(value: Column, h: Column, length: int = 16) -> Column:
    """length letters and digits (1 to 64), whatever the value."""
    return draw(h, F.lit(min(max(length, 1), 64)), MIXED)


def preserve_length(value: Column, h: Column) -> Column:
    """As many small letters and digits as the value has bytes."""
    return draw(h, F.octet_length(value), LOWER)


def random_uuid(value: Column, h: Column) -> Column:
    """A version 4 UUID of the hash's first 16 bytes."""
    part = lambda a, n: F.substr(h, F.lit(a + 1), F.lit(n))
    variant = F.translate(part(16, 1), string.hexdigits[:16], "89ab" * 4)
    return F.concat(part(0, 8), F.lit("-"), part(8, 4), F.lit("-4"), part(13, 3), F.lit("-"), variant, part(17, 3), F.lit("-"), part(20, 12))


def fake_ip(value: Column, h: Column) -> Column:
    """Dots stay, every other character becomes a digit."""
    return F.when(value.rlike("[^.]"), _fold(value, h, "[^.]", lambda b, c, k: (b % 10).cast("string"))).otherwise(value)


def hmac_hash(value: Column, key: bytes, length: int = 32) -> Column:
    """The first length hex digits (1 to 64) of HMAC-SHA256(key, value); a key of its own, no category in it."""
    inner = F.sha2(F.concat(F.unhex(F.lit(_pad(key, 0x36))), F.encode(value, "UTF-8")), 256)
    return F.substr(F.sha2(F.concat(F.unhex(F.lit(_pad(key, 0x5C))), F.unhex(inner)), 256), F.lit(1), F.lit(min(max(length, 1), 64)))


Strategy = Callable[[Column, Column], Column]
STRATEGIES: dict[str, Strategy] = {"random_string": random_string, "random_uuid": random_uuid, "fake_ip": fake_ip, "preserve_length": preserve_length, "hmac_hash": lambda v, h: hmac_hash(v, DEMO_KEY)}


def register(name: str, strategy: Strategy) -> None:
    """Adds a strategy: a pure function of the value's and the entropy's Columns."""
    if name in STRATEGIES or name == "category_aware":
        raise ValueError(f"strategy {name} exists")
    STRATEGIES[name] = strategy


def apply(name: str, value: Column, category: str, key: bytes = DEMO_KEY) -> Column:
    """The replacement of a value by the named strategy; a null value gives null. category_aware is the category's own format.

    For replacements that differ from run to run, pass a key drawn for the run.
    """
    if name == "category_aware":
        return replace(value, category, key)
    return F.when(value.isNotNull(), STRATEGIES[name](value, hmac_hex(value, category, key)))
