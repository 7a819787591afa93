"""Replacements whose length is drawn from a band of the category, so that it tells nothing of the value's.

The draw comes from the hash, so a value has one length wherever it stands.
Categories of a fixed shape (addresses, ids, tokens in three parts) keep theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import replace as fixed
from .arrays import emit, let
from .replace import DEMO_KEY, TOKEN_HEAD, TOKEN_TAIL, byte_at, hex_of, hmac_hex, is_mask

#: Least and greatest length of what is drawn, in bytes (fixed values).
DIGITS, EMAIL_USER, HOST_PREFIX, NAME, TOKEN, SEGMENT = (8, 18), (6, 16), (6, 16), (12, 28), (24, 48), (6, 20)


def _pick(word: Column, band: tuple[int, int]) -> Column:
    """A length of the band from 16 hex digits, taken as an unsigned number of 64 bits."""
    return (F.lit(band[0]) + F.pmod(F.conv(word, 16, 10).cast("decimal(20,0)"), F.lit(band[1] - band[0] + 1))).cast("int")


def _by_hash(h: Column, band: tuple[int, int]) -> Column:
    return _pick(F.substr(h, F.lit(1), F.lit(16)), band)


def _by_signs(h: Column, number: Column | int) -> Column:
    """The length of a text's segment by its number: from eight of the hash's hex signs, as bytes."""
    at = F.pmod((number if isinstance(number, Column) else F.lit(number)) * 8, F.lit(64))
    return _pick(F.hex(F.encode(F.substr(h, at + 1, F.lit(8)), "UTF-8")), SEGMENT)


def _hex_from(h: Column, start: Column, n: Column) -> Column:
    return F.substr(F.repeat(h, F.lit(3)), F.pmod(start, F.lit(64)) + 1, n)


def email(value: Column, h: Column) -> Column:
    domain = F.when(F.contains(value, F.lit("@")), F.substring_index(value, "@", -1)).otherwise("x.co")
    return F.concat(hex_of(h, _by_hash(h, EMAIL_USER)), F.lit("@"), domain)


def digits(value: Column, h: Column) -> Column:
    n = _by_hash(h, DIGITS)
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(byte_at(h, i), F.lit(10)).cast("string")), "")


def ssn(value: Column, h: Column) -> Column:
    return F.concat(F.lit("0"), F.substr(digits(value, h), F.lit(2)))


def name(value: Column, h: Column) -> Column:
    return fixed.name(F.repeat(F.lit("x"), _by_hash(h, NAME)), h)


def token(value: Column, h: Column) -> Column:
    return F.concat(F.lit(TOKEN_HEAD), hex_of(h, _by_hash(h, TOKEN)), F.lit(TOKEN_TAIL))


def hostname(value: Column, h: Column) -> Column:
    port, host, tail = fixed.host_parts(value)
    drawn = F.concat(hex_of(h, _by_hash(h, HOST_PREFIX)), tail, port)
    return F.when(fixed.is_address(host), fixed.hostname(value, h)).otherwise(drawn)


def _segments(value: Column, h: Column, stays: str) -> Column:
    """Signs of the class stay; each run of others becomes a hex run of a drawn length."""
    runs = F.regexp_extract_all(value, F.lit(f"{stays}+|(?:(?!{stays})(?s:.))+"), 0)

    def step(s: Column, run: Column) -> tuple[Column, Column]:
        kept = run.rlike(rf"\A{stays}")
        n = F.when(kept, 0).otherwise(_by_signs(h, s["k"] + 1))
        made = F.when(kept, run).otherwise(_hex_from(h, s["at"], n))
        return F.struct((s["k"] + F.when(kept, 0).otherwise(1)).alias("k"), (s["at"] + n).alias("at")), F.array(made)

    return F.array_join(emit(runs, F.struct(F.lit(0).alias("k"), F.lit(0).alias("at")), "string", step), "")


def url(value: Column, h: Column) -> Column:
    scheme = F.regexp_extract(value, r"\A[A-Za-z0-9+.-]*://", 0)
    return F.concat(scheme, _segments(F.substr(value, F.char_length(scheme) + 1), h, "[/:?=&#@.]"))


def aws_arn(value: Column, h: Column) -> Column:
    return _segments(value, h, "[:/]")


def file_path(value: Column, h: Column) -> Column:
    """The directories keep their lengths, the file's name has one drawn, its ending stays."""
    folder = F.regexp_extract(value, r"(?s)\A.*[/\\]", 0)
    ending = F.regexp_extract(F.substr(value, F.char_length(folder) + 1), r"(?s)\A.+?(\.[^.]*)\z", 1)
    past = F.octet_length(F.regexp_replace(folder, r"[/\\]", ""))
    return F.concat(fixed.file_path(folder, h), _hex_from(h, past, _by_signs(h, 0)), ending)


def azure_resource_id(value: Column, h: Column) -> Column:
    parts = F.split(value, "/")

    def step(s: Column, p: Column) -> tuple[Column, Column]:
        stays = (p == "") | p.isin(*fixed.AZURE_PARTS) | (s["after"] & F.contains(p, F.lit(".")))
        n = F.when(stays, 0).otherwise(_by_signs(h, s["k"] + 1))
        new = F.struct((s["k"] + F.when(stays, 0).otherwise(1)).alias("k"), (s["at"] + n).alias("at"), p.isin("providers", "Providers").alias("after"))
        return new, F.array(F.when(stays, p).otherwise(_hex_from(h, s["at"], n)))

    begin = F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(False).alias("after"))
    return F.array_join(emit(parts, begin, "string", step), "/")


DRAWN = {"email": email, "phone": digits, "credit_card": digits, "ssn": ssn, "name": name, "hostname": hostname, "url": url, "aws_arn": aws_arn, "file_path": file_path, "azure_resource_id": azure_resource_id}


def replace_drawn(value: Column, category: str, key: bytes = DEMO_KEY) -> Column:
    """replace() with a drawn length where the category has no fixed shape; an empty value stays empty, a mask as it is."""
    form = DRAWN.get(category) or fixed.FORMATS.get(category) or token
    made = let(hmac_hex(value, category, key), lambda h: form(value, h))
    return F.when((value == "") | is_mask(value), value).otherwise(made)


def drawn_for(categories: Sequence[str], key: bytes = DEMO_KEY):
    """A function for scan.redact(made=...): replacements of drawn lengths by the number of the rule."""

    def made(value: Column, rule: Column) -> Column:
        out = None
        for c in dict.fromkeys(categories):
            out = (F if out is None else out).when(rule.isin([k for k, x in enumerate(categories) if x == c]), replace_drawn(value, c, key))
        return out

    return made
