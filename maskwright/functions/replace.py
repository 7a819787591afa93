"""Length-preserving replacements as Catalyst expressions over HMAC-SHA256, one for each category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import domain_tag
from .arrays import let

DEMO_KEY = bytes(range(32))
#: The frame of opaque tokens (fixed values).
TOKEN_HEAD, TOKEN_TAIL = "__SANITIZED_", "__"


def _pad(key: bytes, x: int) -> str:
    return bytes(b ^ x for b in key.ljust(64, b"\0")).hex()


def hmac_parts(key: bytes, category: str) -> tuple[str, str]:
    """Hex of what stands before the value in the inner hash, and before the inner hash in the outer."""
    return _pad(key, 0x36) + domain_tag(category).encode().hex() + "00", _pad(key, 0x5C)


def hmac_hex(value: Column, category: str, key: bytes) -> Column:
    """64 hex digits of HMAC-SHA256(key, tag, 00, value)."""
    inner, outer = hmac_parts(key, category)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(value, "UTF-8")), 256))), 256)


def byte_at(hex_: Column, i: Column | int) -> Column:
    """Byte i mod 32 of the hash, as a number."""
    k = F.pmod(i if isinstance(i, Column) else F.lit(i), F.lit(32))
    return F.conv(F.substr(hex_, k * 2 + 1, F.lit(2)), 16, 10).cast("int")


def hex_of(hex_: Column, n: Column) -> Column:
    return F.substr(F.repeat(hex_, F.ceil(F.greatest(n, F.lit(1)) / 64).cast("int")), F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def _fold(value: Column, hex_: Column, digit: str, draw) -> Column:
    """Replaces characters of the class by draw(byte of the hash, character, index of the hit); hex if there are none."""
    step = lambda acc, c: F.when(c.rlike(digit), F.struct(F.concat(acc["t"], draw(byte_at(hex_, acc["n"]), c, acc["n"])).alias("t"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["t"], c).alias("t"), acc["n"].alias("n")))
    folded = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), step, lambda acc: acc["t"])
    return F.when(value.rlike(digit), folded).otherwise(hex_of(hex_, F.octet_length(value)))


def email(value: Column, h: Column) -> Column:
    domain = F.when(F.contains(value, F.lit("@")), F.substring_index(value, "@", -1)).otherwise("x.co")
    user = F.octet_length(value) - 1 - F.octet_length(domain)
    return F.when(user <= 0, hex_of(h, F.octet_length(value))).otherwise(F.concat(hex_of(h, user), F.lit("@"), domain))


def digits(value: Column, h: Column) -> Column:
    return _fold(value, h, "[0-9]", lambda b, c, i: F.pmod(b, F.lit(10)).cast("string"))


def ssn(value: Column, h: Column) -> Column:
    return _fold(value, h, "[0-9]", lambda b, c, i: F.when(i < 3, F.lit("0")).otherwise(F.pmod(byte_at(h, i - 3), F.lit(10)).cast("string")))


def hex_digits(value: Column, h: Column) -> Column:
    nibble = lambda b: F.lower(F.conv(F.pmod(b, F.lit(16)), 10, 16))
    return _fold(value, h, "[0-9a-fA-F]", lambda b, c, i: F.when(c.rlike("[A-F]"), F.upper(nibble(b))).otherwise(nibble(b)))


def ipv4(value: Column, h: Column) -> Column:
    def part(p: Column, i: Column) -> Column:
        word = byte_at(h, i * 2) * 256 + byte_at(h, i * 2 + 1)
        span = lambda lo, hi: (F.lit(lo) + F.pmod(word, F.lit(hi - lo + 1))).cast("string")
        other = F.array_join(F.transform(F.split(p, ""), lambda c, j: F.when(c.rlike("^[0-9]$"), F.pmod(byte_at(h, i * 4 + j), F.lit(10)).cast("string")).otherwise(c)), "")
        return F.when(p.rlike("^[0-9]$"), span(0, 9)).when(p.rlike("^[0-9]{2}$"), span(10, 99)).when(p.rlike("^[0-9]{3}$"), span(100, 255)).when(p == "", "").otherwise(other)

    return F.array_join(F.transform(F.split(value, "\\."), part), ".")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_GROUP = "[0-9A-Fa-f]{1,4}"


def _ipv6() -> str:
    """Full and shortened IPv6 forms: n groups before :: and at most 7 - n behind it, the last two perhaps as IPv4."""
    tail = lambda n: rf"(?:{_GROUP}:){{0,{n - 1}}}{_GROUP}" + (rf"|(?:{_GROUP}:){{0,{n - 2}}}{_IPV4}" if n >= 2 else "")
    full = rf"(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{6}}{_IPV4}"
    short = [rf"::(?:{tail(7)})?"] + [rf"(?:{_GROUP}:){{{n}}}:" + (rf"(?:{tail(7 - n)})?" if n < 7 else "") for n in range(1, 8)]
    return rf"\A(?:{full}|{'|'.join(short)})\z"


def host_parts(value: Column) -> tuple[Column, Column, Column]:
    """The port with its colon, the host, and the labels of the host that stay: at most the last two, none before a number."""
    port = F.regexp_extract(value, r":[0-9]+\z", 0)
    host = F.substr(value, F.lit(1), F.char_length(value) - F.char_length(port))
    labels = F.split(host, "\\.")
    tail = F.when(F.size(labels) < 2, "").when(F.element_at(labels, -1).rlike("^[0-9]+$"), "").when(F.size(labels) == 2, F.concat(F.lit("."), F.substring_index(host, ".", -1))).otherwise(F.concat(F.lit("."), F.substring_index(host, ".", -2)))
    return port, host, tail


def is_address(host: Column) -> Column:
    """Whether a host has the shape of an IP address."""
    return host.rlike(rf"\A{_IPV4}\z") | host.rlike(_ipv6())


def hostname(value: Column, h: Column) -> Column:
    """A port stays; IP shapes go by ipv4 and hex_digits; of names, the tail stays."""
    port, host, tail = host_parts(value)
    n = F.octet_length(host)
    left = n - F.octet_length(tail)
    name = F.when(left <= 0, hex_of(h, n)).otherwise(F.concat(hex_of(h, left), tail))
    return F.concat(F.when(host.rlike(rf"\A{_IPV4}\z"), ipv4(host, h)).when(host.rlike(_ipv6()), hex_digits(host, h)).otherwise(name), port)


#: Signs of opaque base64url runs, by number.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
#: Parts of synthetic names, by number (fixed values).
FIRST = ("Alex", "Blake", "Casey", "Dana", "Ellis", "Finley", "Gray", "Harper", "Ira", "Jordan", "Kai", "Lane", "Morgan", "Noel", "Oakley", "Parker", "Quinn", "Reese", "Sage", "Taylor", "Uri", "Val", "Wren", "Xen", "Yael", "Zion", "Arden", "Blair", "Corin", "Drew", "Emery", "Frost")
LAST = ("Ashford", "Blackwell", "Crawford", "Dalton", "Eastwood", "Fairbanks", "Garrison", "Hartley", "Irvine", "Jensen", "Kendrick", "Langley", "Mercer", "Newland", "Oakwood", "Preston", "Quinlan", "Redmond", "Shepard", "Thornton", "Underwood", "Vance", "Whitmore", "Xavier", "Yardley", "Zimmer", "Ashton", "Beckett", "Calloway", "Dempsey", "Eldridge", "Fletcher")
#: Path parts of Azure ids that stay (fixed values).
AZURE_PARTS = ("subscriptions", "resourceGroups", "resourcegroups", "providers")


def _bytewise(value: Column, stays: str, draw) -> Column:
    """Characters of the class stay; any other becomes one sign for each of its bytes, draw(number of the byte)."""

    def step(acc: Column, c: Column) -> Column:
        n = F.octet_length(c)
        made = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda j: draw(acc["n"] + j)), "")
        return F.when(c.rlike(stays), F.struct(F.concat(acc["t"], c).alias("t"), acc["n"].alias("n"))).otherwise(F.struct(F.concat(acc["t"], made).alias("t"), (acc["n"] + n).alias("n")))

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), step, lambda acc: acc["t"])


def _hex_draw(h: Column):
    return lambda i: F.substr(h, F.pmod(i, F.lit(64)) + 1, F.lit(1))


def _keeping(value: Column, h: Column, stays: str) -> Column:
    """Hex for all characters but those of the class; all hex if there are no others."""
    return F.when(value.rlike(rf"\A{stays}*\z"), hex_of(h, F.octet_length(value))).otherwise(_bytewise(value, stays, _hex_draw(h)))


def jwt(value: Column, h: Column) -> Column:
    signs = F.lit(ALPHABET)
    made = _bytewise(value, "[.=]", lambda i: F.substr(signs, F.pmod(byte_at(h, i), F.lit(64)) + 1, F.lit(1)))
    return F.when(value.rlike(r"\A[.=]*\z"), hex_of(h, F.octet_length(value))).otherwise(made)


def file_path(value: Column, h: Column) -> Column:
    ending = F.regexp_extract(value, r"[^/\\](\.[^./\\]*)\z", 1)
    body = F.substr(value, F.lit(1), F.char_length(value) - F.char_length(ending))
    return F.concat(_bytewise(body, r"[/\\]", _hex_draw(h)), ending)


def windows_sid(value: Column, h: Column) -> Column:
    made = _bytewise(value, "[S-]", lambda i: F.pmod(byte_at(h, i), F.lit(10)).cast("string"))
    return F.when(value.rlike("[0-9]"), made).otherwise(hex_of(h, F.octet_length(value)))


def url(value: Column, h: Column) -> Column:
    scheme = F.regexp_extract(value, r"\A[A-Za-z0-9+.-]*://", 0)
    return F.concat(scheme, _keeping(F.substr(value, F.char_length(scheme) + 1), h, "[/:?=&#@.]"))


def aws_arn(value: Column, h: Column) -> Column:
    return _keeping(value, h, "[:/]")


def azure_resource_id(value: Column, h: Column) -> Column:
    """Hex for each part, but for known ones and a dotted one right behind providers; hex runs on over the parts."""

    def step(acc: Column, p: Column) -> Column:
        stays = (p == "") | p.isin(*AZURE_PARTS) | (acc["after"] & F.contains(p, F.lit(".")))
        n = F.when(stays, F.lit(0)).otherwise(F.octet_length(p))
        at = F.pmod(acc["n"], F.lit(64)).cast("int")
        made = F.when(stays, p).otherwise(F.substr(hex_of(h, n + 64), at + 1, n))
        return F.struct(F.concat(acc["t"], F.lit("/"), made).alias("t"), (acc["n"] + n).alias("n"), p.isin("providers", "Providers").alias("after"))

    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(False).alias("after"))
    return F.aggregate(F.split(value, "/"), zero, step, lambda acc: F.substr(acc["t"], F.lit(2)))


def name(value: Column, h: Column) -> Column:
    """Two parts of the tables, cut or filled with hex to the value's length."""
    part = lambda words, i: F.element_at(F.array(*(F.lit(w) for w in words)), F.pmod(byte_at(h, i), F.lit(32)) + 1)
    both = F.concat(part(FIRST, 0), F.lit(" "), part(LAST, 1))
    n = F.octet_length(value)
    return F.concat(F.substr(both, F.lit(1), n), hex_of(h, n - F.char_length(both)))


def token(value: Column, h: Column) -> Column:
    n = F.octet_length(value)
    over = len(TOKEN_HEAD) + len(TOKEN_TAIL)
    return F.when(n <= over, hex_of(h, n)).otherwise(F.concat(F.lit(TOKEN_HEAD), hex_of(h, n - over), F.lit(TOKEN_TAIL)))


FORMATS = {"email": email, "ipv4": ipv4, "phone": digits, "credit_card": digits, "ssn": ssn, "ipv6": hex_digits, "mac_address": hex_digits, "uuid": hex_digits, "container_id": hex_digits, "hostname": hostname, "jwt": jwt, "file_path": file_path, "windows_sid": windows_sid, "url": url, "aws_arn": aws_arn, "azure_resource_id": azure_resource_id, "name": name}


def is_mask(value: Column) -> Column:
    """Whether a value is three or more of one masking sign."""
    return value.rlike(r"\A(\*{3,}|•{3,}|#{3,})\z")


def replace(value: Column, category: str, key: bytes = DEMO_KEY) -> Column:
    """The replacement of a value; empty stays empty, a mask (three or more of one sign) stays as it is.

    Tokens and custom categories become opaque tokens.
    """
    # the hash is used for every character: it is bound, not written out in each place
    made = let(hmac_hex(value, category, key), lambda h: FORMATS.get(category, token)(value, h))
    return F.when((value == "") | is_mask(value), value).otherwise(made)


def replace_any(value: Column, which: Column, categories: Sequence[str], key: bytes = DEMO_KEY) -> Column:
    """replace() by the category that which (a number) has in categories, with one hash for all of them."""
    names = list(dict.fromkeys(categories))
    inner = F.element_at(F.array(*(F.lit(hmac_parts(key, c)[0]) for c in categories)), which + 1)
    outer = F.unhex(F.lit(hmac_parts(key, names[0])[1]))
    h = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(F.unhex(inner), F.encode(value, "UTF-8")), 256))), 256)

    def made(h: Column) -> Column:
        out, forms = None, {}
        for k, c in enumerate(categories):
            forms.setdefault(FORMATS.get(c, token), []).append(k)
        for form, numbers in forms.items():
            out = (F if out is None else out).when(which.isin(numbers), form(value, h))
        return out

    return F.when((value == "") | is_mask(value), value).otherwise(let(h, made))
