"""Rule files in YAML, JSON or TOML: detection rules, literals, allow lists, entropy rules and field-name signals."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field

from ..operators.entropy import EntropyRule
from ..operators.fields import Signal
from ..rules import CATEGORIES, MAX_LITERALS, MAX_REGEXES, Rule

KINDS = ("regex", "literal", "allow", "entropy", "field-name")


class RuleFileError(ValueError):
    """A rule file that cannot be used; its text names entries by number, never by what they hold."""


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    allow: list[str] = field(default_factory=list)
    entropy: list[EntropyRule] = field(default_factory=list)
    signals: list[Signal] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def structured(self, found: list[Rule] = ()) -> list[Rule]:
        """The rules for the scan after the format readers: those on key-value texts go, literals found come in."""
        return [r for r in self.rules if not r.label.endswith("_kv")] + list(found)


def category(name: str | None) -> str:
    """A built-in category, or a custom one."""
    name = name or "auth_token"
    return name if name in CATEGORIES or name.startswith("custom:") else f"custom:{name}"


def parse(text: str, name: str = "") -> list[dict]:
    """The entries of a rule file, whose format its name's ending or else its content tells."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext not in ("json", "toml", "yaml", "yml"):
        ext = "toml" if re.search(r"(?m)^\[\[\w", text) else "json" if text.lstrip()[:1] in ("[", "{") else "yaml"
    try:
        if ext == "json":
            data = json.loads(text)
        elif ext == "toml":
            data = tomllib.loads(text)
        else:
            try:
                import yaml
            except ImportError as e:
                raise RuleFileError("rule files in YAML need the yaml package") from e
            try:
                data = yaml.safe_load(text)
            except yaml.YAMLError as e:
                raise RuleFileError("not a YAML rule file") from e
    except (json.JSONDecodeError, tomllib.TOMLDecodeError) as e:
        raise RuleFileError(f"not a {ext.upper()} rule file") from e
    if isinstance(data, dict):
        data = next((v for v in data.values() if isinstance(v, list)), [data] if data else [])
    if data is None:
        return []
    if not isinstance(data, list) or not all(isinstance(e, dict) for e in data):
        raise RuleFileError("a rule file is a list of entries")
    return data


def compile_rules(entries: list[dict], strict: bool = False) -> RuleSet:
    """Entries as rules, in order; a bad entry is an error in the result, or raises if strict."""
    out = RuleSet()
    for k, e in enumerate(entries):
        try:
            _add(out, e)
        except (ValueError, TypeError, KeyError, re.error) as bad:
            message = f"entry {k}: {type(bad).__name__}"
            if strict:
                raise RuleFileError(message) from None
            out.errors.append(message)
    if sum(r.kind == "regex" for r in out.rules) > MAX_REGEXES or sum(r.kind == "literal" for r in out.rules) > MAX_LITERALS:
        raise RuleFileError("too many rules")
    return out


def _add(out: RuleSet, e: dict) -> None:
    kind = e.get("kind", "literal")
    if kind not in KINDS:
        raise ValueError("unknown kind")
    values = list(e.get("values") or ([e["pattern"]] if kind != "entropy" else []))
    label = e.get("label") or e.get("category") or "rule"
    group = category(e.get("category"))
    if kind == "allow":
        out.allow += values
    elif kind == "entropy":
        given = {k: e[k] for k in ("min_length", "max_length", "threshold", "charset") if e.get(k) is not None}
        out.entropy.append(EntropyRule(label=e.get("label") or "high_entropy_token", category=group, **given))
    elif kind == "field-name":
        out.signals += [Signal(v, category(e.get("category") or "custom:credential"), e.get("label") or "field-name-signal", float(e.get("threshold", 3.0))) for v in values if re.compile(v)]
    else:
        least = e.get("min_length")
        out.rules += [Rule(v, group, label, kind, len(v.encode()) if kind == "literal" and least is None else least, e.get("max_length")) for v in values]


def quick_rules(texts: list[str]) -> RuleSet:
    """Rules given in a call: a literal each, or a pattern after ``regex:``."""
    return compile_rules([{"kind": "regex", "pattern": t[6:]} if t.startswith("regex:") else {"kind": "literal", "pattern": t} for t in texts], strict=True)


def merge(*layers: RuleSet) -> RuleSet:
    """Rule sets in the order of their precedence; a pattern known already is skipped."""
    out = RuleSet()
    seen = set()
    for layer in layers:
        for r in layer.rules:
            if (r.kind, r.pattern) not in seen:
                seen.add((r.kind, r.pattern))
                out.rules.append(r)
        for name in ("allow", "entropy", "signals", "errors"):
            getattr(out, name).extend(x for x in getattr(layer, name) if x not in getattr(out, name))
    return out
