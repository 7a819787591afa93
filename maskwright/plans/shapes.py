"""Queries of the replacements whose shape keeps parts of the value, with their SQL (over ASCII values)."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.replace import ALPHABET, FIRST, LAST


def kept(v: str, stays: str, draw: str) -> str:
    """draw has $k, the number of characters before that do not stay."""
    k = f"length(regexp_replace(left({v}, i - 1), '{stays}', '', 'g'))"
    return f"array_to_string(list_transform(string_split({v}, ''), lambda c, i: CASE WHEN regexp_matches(c, '{stays}') THEN c ELSE {draw.replace('$k', k)} END), '')"


_HEX = "substr(h, (($k) % 64 + 1)::BIGINT, 1)"


def shapes(byte: Callable[[str, str], str]) -> dict[str, tuple[str, str]]:
    """By category: the value from customer's columns, and the SQL of its replacement from v and h."""
    of = lambda words, i: f"[{', '.join(repr(w) for w in words)}][{byte('h', i)} % 32 + 1]"
    both = f"({of(FIRST, '0')} || ' ' || {of(LAST, '1')})"
    end = r"regexp_extract(v, '\.[^./]*$')"
    body = f"left(v, length(v) - length({end}))"
    rest = "substr(v, 9)"
    host = "regexp_replace(v, ':[0-9]+$', '')"
    tail = rf"regexp_extract({host}, '(\.[^.]+)?\.[^.]+$')"
    part = "CASE WHEN p IN ('', 'subscriptions', 'resourceGroups', 'providers', 'Acme.Compute') THEN p ELSE substr(repeat(h, 2), (length(replace(replace(replace(array_to_string(list_slice(string_split(v, '/'), 1, i - 1), ''), 'subscriptions', ''), 'resourceGroups', ''), 'providersAcme.Compute', '')) % 64 + 1)::BIGINT, length(p)) END"
    return {
        "jwt": ("concat('eyJ', md5(c_name), '.', md5(c_mktsegment), '.', c_mktsegment, '_-')", kept("v", "[.=]", f"substr('{ALPHABET}', ({byte('h', '$k')} % 64 + 1)::BIGINT, 1)")),
        "file_path": ("concat('/srv/', lower(c_mktsegment), '/', md5(c_name), '.tar.gz')", f"{kept(body, '[/]', _HEX)} || {end}"),
        "windows_sid": ("concat('S-1-5-21-', substr(c_name, 10, 9), '-', cast(c_custkey as {text}))", kept("v", "[S-]", f"({byte('h', '$k')} % 10)::VARCHAR")),
        "url": ("concat('https://', lower(c_mktsegment), '.example/a?id=', md5(c_name), '&k=1#x')", f"'https://' || {kept(rest, '[/:?=&#@.]', _HEX)}"),
        "aws_arn": ("concat('arn:aws:s3:::', lower(c_mktsegment), '/', md5(c_name))", kept("v", "[:/]", _HEX)),
        "azure_resource_id": ("concat('/subscriptions/', md5(c_name), '/resourceGroups/', lower(c_mktsegment), '/providers/Acme.Compute/vm', substr(c_name, 10, 9))", f"array_to_string(list_transform(string_split(v, '/'), lambda p, i: {part}), '/')"),
        "hostname": ("concat(lower(c_mktsegment), '-', substr(c_name, 10, 9), '.zone', cast(c_nationkey as {text}), '.corp.example:8443')", f"left(h, length({host}) - length({tail})) || {tail} || ':8443'"),
        "name": ("concat(c_mktsegment, ' ', substr(c_name, 1, c_nationkey))", f"left({both}, length(v)) || left(h, greatest(length(v) - length({both}), 0))"),
    }
