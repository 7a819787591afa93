"""Format readers: where the values of a structured text stand.

A reader takes a whole text and returns its values as spans (path, start,
stop, value, style), in order and without overlap; start and stop are
characters of the text, style tells how a new value is written there. Readers
never change a text and know nothing of rules or replacements: those stay in
Catalyst (``operators.fields``), and only the parsing runs in Python, batch by
batch. A text that its reader cannot parse has no spans (None).
"""

from __future__ import annotations

import json as _json
import re
from collections.abc import Callable, Iterator

#: Styles: as it is; within double quotes; bare, so that quotes must be added; XML; within a quoted CSV field.
RAW, QUOTED, BARE, XML, DOUBLED = range(5)
MAX_DEPTH = 128
Span = tuple[str, int, int, str, int]


class Malformed(ValueError):
    """The text is not of the format; says where, never what."""


def _join(path: str, key: str, by: str = ".") -> str:
    return f"{path}{by}{key}" if path else key


_JSON_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|([\[\]{},:])|([^\s\[\]{},:"]+))', re.S)


_JSON_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.S)
_JSON_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[\]}])', re.S)


def _blanked(text: str) -> str:
    """The text with comments and trailing commas as spaces: every other character stays in its place."""
    blank = lambda m: m[1] or re.sub(r"[^\n]", " ", m[0])
    return _JSON_COMMA.sub(blank, _JSON_COMMENT.sub(blank, text))


def json(text: str, base: int = 0) -> list[Span]:
    """Every scalar of a JSON value by its dotted path; arrays leave the path as it is.

    A text that is no JSON as it stands is read without its comments and
    trailing commas.
    """
    try:
        return _strict_json(text, base)
    except Malformed:
        plain = _blanked(text)
        if plain == text:
            raise
        return _strict_json(plain, base)


def _strict_json(text: str, base: int) -> list[Span]:
    """Every scalar of a JSON value by its dotted path; arrays leave the path as it is."""
    out: list[Span] = []
    stack: list[tuple[str, str]] = []  # (closing sign, path)
    path, key, want_key, at = "", None, False, 1 if text.startswith("﻿") else 0
    end = len(text.rstrip())
    done = False
    while at < end:
        m = _JSON_TOKEN.match(text, at)
        if m is None or done:
            raise Malformed(f"JSON: character {at}")
        at = m.end()
        string, sign, scalar = m.groups()
        here = _join(path, key) if key is not None else path
        if sign in ("{", "["):
            if len(stack) >= MAX_DEPTH:
                raise Malformed(f"JSON: too deep at character {at}")
            stack.append(("}" if sign == "{" else "]", path))
            path, key, want_key = here, None, sign == "{"
        elif sign in ("}", "]"):
            if not stack or stack[-1][0] != sign:
                raise Malformed(f"JSON: character {at}")
            path, key, want_key = stack.pop()[1], None, False
            done = not stack
        elif sign == ",":
            key, want_key = None, bool(stack) and stack[-1][0] == "}"
        elif sign == ":":
            if key is None:
                raise Malformed(f"JSON: character {at}")
            want_key = False
        elif string is not None and want_key:
            key = _json.loads(string, strict=False)
        else:
            if string is not None:
                out.append((here, base + m.start(1) + 1, base + m.end(1) - 1, _json.loads(string, strict=False), QUOTED))
            else:
                if scalar not in ("true", "false", "null") and not re.fullmatch(r"[+-]?(?:[0-9.][0-9.eE+-]*|Infinity|NaN|0[xX][0-9a-fA-F]+)", scalar):
                    raise Malformed(f"JSON: character {at}")
                out.append((here, base + m.start(3), base + m.end(3), scalar, BARE))
            done = not stack
    if stack:
        raise Malformed("JSON: it ends early")
    return out


def _lines(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of every line, without its line end."""
    at = 0
    for line in text.split("\n"):
        yield at, line[:-1] if line.endswith("\r") else line
        at += len(line) + 1


def _next_line(text: str, at: int) -> int:
    k = text.find("\n", at)
    return len(text) if k < 0 else k + 1


def jsonl(text: str, skip_invalid: bool = True) -> list[Span]:
    """The spans of each line's JSON value; invalid lines have none, or spoil the text if skip_invalid is off."""
    out: list[Span] = []
    for at, line in _lines(text):
        try:
            out += json(line, at) if line.strip() else []
        except ValueError:
            if not skip_invalid:
                raise
    return out


def _closing(line: str, at: int) -> int:
    """The place behind the brace that closes the one at ``at``; -1 if there is none."""
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*"|[{}]').finditer(line, at):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if depth == 0:
            return m.end()
    return -1


def log(text: str) -> list[Span]:
    """The first {...} of every line, read as JSON; other lines have none."""
    out: list[Span] = []
    for at, line in _lines(text):
        k = line.find("{")
        stop = _closing(line, k) if k >= 0 else -1
        if stop > 0:
            try:
                out += json(line[k:stop], at + k)
            except ValueError:
                continue
    return out


def csv(text: str, delimiter: str = ",", has_header: bool = True) -> list[Span]:
    """Fields by the name of their column, or by its number from 0 without a header or beyond it."""
    out: list[Span] = []
    field = re.compile(rf'"((?:[^"]|"")*)"|([^{re.escape(delimiter)}\r\n]*)')
    at, row, header = 1 if text.startswith("﻿") else 0, 0, []
    while at < len(text):
        k = 0
        while True:
            m = field.match(text, at)
            quoted = m.group(1) is not None
            value = m.group(1).replace('""', '"') if quoted else m.group(2)
            if has_header and row == 0:
                header.append(value)
            elif value:
                start, stop = m.span(1 if quoted else 2)
                out.append((header[k] if k < len(header) else str(k), start, stop, value, DOUBLED if quoted else RAW))
            at, k = m.end(), k + 1
            if at < len(text) and text.startswith(delimiter, at):
                at += len(delimiter)
                continue
            if at < len(text) and text[at] not in "\r\n":
                raise Malformed(f"CSV: character {at}")
            break
        at += 2 if text.startswith("\r\n", at) else 1
        row += 1
    return out


def tsv(text: str, has_header: bool = True) -> list[Span]:
    return csv(text, "\t", has_header)


_ENV = re.compile(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.-]*)\s*=\s*")


def _shell_value(line: str, at: int, comments: str) -> tuple[int, int, str]:
    """Start, stop and text of a value that may be quoted; a bare one ends where a comment begins, but its span goes on to the line's end."""
    q = line[at : at + 1]
    if q and q in "\"'" and (k := line.find(q, at + 1)) > 0:
        return at + 1, k, line[at + 1 : k]
    value = re.split(rf"\s[{comments}]", line[at:], maxsplit=1)[0].rstrip()
    return at, len(line.rstrip()), value


def env(text: str) -> list[Span]:
    """NAME=value lines by name; a comment behind a bare value goes with it."""
    out: list[Span] = []
    for at, line in _lines(text):
        if (m := _ENV.match(line)) is not None:
            start, stop, value = _shell_value(line, m.end(), "#")
            if value:
                out.append((m.group(1), at + start, at + stop, value, RAW))
    return out


def ini(text: str) -> list[Span]:
    """key = value or key: value lines by section.key, or by key before the first section."""
    out: list[Span] = []
    section = ""
    for at, line in _lines(text):
        bare = line.strip()
        if not bare or bare[0] in "#;":
            continue
        if bare[0] == "[" and "]" in bare:
            section = bare[1 : bare.index("]")].strip()
            continue
        k = line.find("=") if "=" in line else line.find(":")
        if k <= 0:
            continue
        start = k + 1 + len(line[k + 1 :]) - len(line[k + 1 :].lstrip())
        start, stop, value = _shell_value(line, start, "#;")
        if value:
            out.append((_join(section, line[:k].strip()), at + start, at + stop, value, RAW))
    return out


_HEREDOC = re.compile(r"<<[-~]?([\"']?)([A-Za-z_][A-Za-z0-9_]*)\1\s*$")


def key_value(text: str, delimiter: str = "=", comment_prefix: str = "#", ignore_comments: bool = False, secondary_delimiters: tuple[str, ...] = (), value_strip_suffix: str = "") -> list[Span]:
    """key = value lines, commented ones too unless ignore_comments; a here-document is one value.

    A line without the delimiter, or with a secondary one at the same place or
    before it, is cut at the first secondary delimiter that it has ("'key' => 'value',").
    A suffix to strip stays in the text and is no part of the value.
    """
    out: list[Span] = []
    inside: tuple[str, str, int] | None = None  # key, end mark, start
    for at, line in _lines(text):
        if inside is not None:
            if line.strip() == inside[1]:
                if at - 1 > inside[2]:
                    out.append((inside[0], inside[2], at - 1, text[inside[2] : at - 1], RAW))
                inside = None
            continue
        body = line.lstrip()
        if comment_prefix and body.startswith(comment_prefix):
            if ignore_comments:
                continue
            body = body[len(comment_prefix) :].lstrip()
        k, by = body.find(delimiter), delimiter
        for other in secondary_delimiters:
            j = body.find(other)
            if j > 0 and (k <= 0 or j < k or j == k and len(other) > len(by)):
                k, by = j, other
                break
        if k <= 0:
            continue
        key = body[:k].strip()
        if by != delimiter:
            key = key.strip("\"':")
        begin = len(line) - len(body) + k + len(by)
        begin += len(line[begin:]) - len(line[begin:].lstrip())
        if (m := _HEREDOC.search(line, begin)) is not None:
            inside = (key, m.group(2), _next_line(text, at))
            continue
        q = line[begin : begin + 1]
        if q and q in "\"'" and (stop := line.find(q, begin + 1)) > 0:
            begin += 1
        else:
            stop = len(line.rstrip().rstrip(",;"))
        if value_strip_suffix and line[begin:stop].endswith(value_strip_suffix):
            stop -= len(value_strip_suffix)
        if stop > begin:
            out.append((key, at + begin, at + stop, line[begin:stop], RAW))
    return out


def command_output(text: str) -> list[Span]:
    """The lines under each "> command" line, up to the next one, to a line of dashes or to the end, as one value by the command."""
    out: list[Span] = []
    command, start = None, 0

    def close(stop: int) -> None:
        body = text[start:stop].strip()
        if command and body:
            first = text.index(body, start)
            out.append((command, first, first + len(body), body, RAW))

    for at, line in _lines(text):
        prompt = line.startswith(">") and line[1:].strip() != ""
        if prompt or re.fullmatch(r"-{3,}\s*", line):
            close(at)
            command, start = (line[1:].strip() if prompt else None), _next_line(text, at)
    close(len(text))
    return out


def columns(text: str, header: str = "") -> list[Span]:
    """Cells of tables of blank-separated columns. A header is a line with a token that the pattern header matches whole; a row has as many tokens at least."""
    out: list[Span] = []
    names: list[str] = []
    for at, line in _lines(text):
        tokens = list(re.finditer(r"\S+", line))
        if header and any(re.fullmatch(header, t.group()) for t in tokens):
            names = [t.group() for t in tokens]
        elif names and len(tokens) >= len(names):
            out += [(n, at + t.start(), at + t.end(), t.group(), RAW) for n, t in zip(names, tokens)]
    return out


_XML = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<![^>]*>|</(?P<close>[^\s>]+)\s*>|<(?P<open>[^\s/>]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>|(?P<text>[^<]+)", re.S)
_ATTR = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ENTITY = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        e = m.group(1)
        return chr(int(e[2:], 16) if e[1:2] in "xX" else int(e[1:])) if e[0] == "#" else _ENTITY.get(e, m.group())

    return re.sub(r"&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|\w+);", one, s)


def xml(text: str) -> list[Span]:
    """Text of elements by a/b and attributes by a/b/@c; comments and declarations are left alone."""
    out: list[Span] = []
    stack: list[str] = []
    at = 0
    while at < len(text):
        m = _XML.match(text, at)
        if m is None or len(stack) > 2 * MAX_DEPTH:
            raise Malformed(f"XML: character {at}")
        at = m.end()
        path = "/".join(stack)
        if m.group("close"):
            if not stack or stack.pop() != m.group("close"):
                raise Malformed(f"XML: character {at}")
        elif m.group("open"):
            stack.append(m.group("open"))
            for a in _ATTR.finditer(m.group("attrs")):
                g = 2 if a.group(2) is not None else 3
                if a.group(g):
                    out.append((f"{'/'.join(stack)}/@{a.group(1)}", m.start("attrs") + a.start(g), m.start("attrs") + a.end(g), _unescape(a.group(g)), XML))
            if m.group("empty"):
                stack.pop()
        elif stack and m.group("cdata") is not None and m.group("cdata"):
            out.append((path, m.start("cdata"), m.end("cdata"), m.group("cdata"), RAW))
        elif stack and m.group("text") and (bare := m.group("text").strip()):
            start = m.start() + m.group("text").index(bare)
            out.append((path, start, start + len(bare), _unescape(bare), XML))
    if stack:
        raise Malformed("XML: it ends early")
    return out


_TOML_VALUE = re.compile(r'"""(?P<ml>.*?)"""|\'\'\'(?P<mr>.*?)\'\'\'|"(?P<s>(?:[^"\\\n]|\\.)*)"|\'(?P<r>[^\'\n]*)\'|(?P<sign>[\[\]{},=])|(?P<c>#[^\n]*)|(?P<nl>\n)|(?P<b>[^\s,\[\]{}=#"\']+(?: [0-9:.Z+-]+)?)', re.S)
_TOML_TABLE = re.compile(r"\s*\[\[?\s*([^\]\n]+?)\s*\]\]?")
_TOML_KEY = re.compile(r'\s*((?:"[^"\n]*"|\'[^\'\n]*\'|[A-Za-z0-9_-]+)(?:\s*\.\s*(?:"[^"\n]*"|\'[^\'\n]*\'|[A-Za-z0-9_-]+))*)\s*=[ \t]*')


def _toml_name(s: str) -> str:
    return ".".join(p.strip().strip("\"'") for p in re.findall(r'"[^"]*"|\'[^\']*\'|[^.\s]+', s))


def toml(text: str) -> list[Span]:
    """Values by table.key; arrays leave the path as it is, inline tables extend it. Numbers, booleans and dates are bare."""
    out: list[Span] = []
    table, at = "", 0
    blank, space = re.compile(r"[ \t]*"), re.compile(r"(?:\s|#[^\n]*)*")
    while (at := space.match(text, at).end()) < len(text):
        if text[at] == "[":
            m = _TOML_TABLE.match(text, at)
            if m is None:
                raise Malformed(f"TOML: character {at}")
            table, at = _toml_name(m.group(1)), m.end()
            continue
        m = _TOML_KEY.match(text, at)
        if m is None:
            raise Malformed(f"TOML: character {at}")
        at = m.end()
        stack: list[tuple[str, str]] = []
        path = _join(table, _toml_name(m.group(1)))
        while True:
            if stack and stack[-1][0] == "}" and (k := _TOML_KEY.match(text, at)) is not None:
                path, at = _join(stack[-1][1], _toml_name(k.group(1))), k.end()
            at = (blank if not stack else space).match(text, at).end()
            v = _TOML_VALUE.match(text, at)
            if v is None:
                raise Malformed(f"TOML: character {at}")
            at = v.end()
            kind = v.lastgroup
            if kind == "sign" and v.group() in "[{":
                stack.append(("]" if v.group() == "[" else "}", path))
            elif kind == "sign" and v.group() in "]}":
                if not stack or stack[-1][0] != v.group():
                    raise Malformed(f"TOML: character {at}")
                path = stack.pop()[1]
            elif kind == "b":
                out.append((path, v.start(), v.end(), v.group(), BARE))
            elif kind in ("s", "ml", "r", "mr") and v.group(kind):
                raw = v.group(kind)
                out.append((path, *v.span(kind), re.sub(r'\\(["\\])', r"\1", raw) if kind in ("s", "ml") else raw, QUOTED if kind in ("s", "ml") else RAW))
            if not stack:
                break
    return out


def yaml(text: str) -> list[Span]:
    """Scalars by dotted path, sequences leave it as it is; block scalars stay blocks, plain ones become quoted."""
    from yaml import MarkedYAMLError, parse
    from yaml.events import AliasEvent, MappingEndEvent, MappingStartEvent, ScalarEvent, SequenceEndEvent, SequenceStartEvent

    out: list[Span] = []
    stack: list[list] = []  # [is a mapping, path, key or None]
    try:
        for e in parse(text):
            top = stack[-1] if stack else None
            here = _join(top[1], top[2]) if top and top[0] and top[2] is not None else top[1] if top else ""
            if isinstance(e, MappingStartEvent | SequenceStartEvent):
                stack.append([isinstance(e, MappingStartEvent), here, None])
                if len(stack) > MAX_DEPTH:
                    raise Malformed("YAML: too deep")
                continue
            if isinstance(e, MappingEndEvent | SequenceEndEvent):
                stack.pop()
                if stack:
                    stack[-1][2] = None
                continue
            if not isinstance(e, ScalarEvent | AliasEvent):
                continue
            if top and top[0] and top[2] is None:
                top[2] = getattr(e, "value", "")
                continue
            if isinstance(e, ScalarEvent) and e.value:
                start, stop = e.start_mark.index, e.end_mark.index
                if e.style in ("'", '"'):
                    out.append((here, start + 1, stop - 1, e.value, QUOTED if e.style == '"' else RAW))
                elif e.style in ("|", ">"):
                    body = text.index("\n", start) + 1
                    body += len(text[body:stop]) - len(text[body:stop].lstrip())
                    last = body + len(text[body:stop].rstrip())
                    out.append((here, body, last, e.value.rstrip("\n"), RAW))
                else:
                    out.append((here, start, stop, e.value, BARE))
            if top:
                top[2] = None
    except MarkedYAMLError as e:
        raise Malformed("YAML: not parsed") from e
    return out


READERS: dict[str, Callable[..., list[Span]]] = {"json": json, "jsonl": jsonl, "yaml": yaml, "toml": toml, "xml": xml, "csv": csv, "tsv": tsv, "env": env, "ini": ini, "key_value": key_value, "log": log, "log_line": log, "command_output": command_output, "columns": columns}
def spans(text: str | None, fmt: str, **options) -> list[Span] | None:
    """The reader's spans; None for a null text or one that it cannot parse."""
    if text is None:
        return None
    try:
        return sorted(READERS[fmt](text, **options), key=lambda s: s[1])
    except (ValueError, RecursionError):
        return None
