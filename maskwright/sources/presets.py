"""Presets: lists of rule-file entries for a kind of input, to be used as they are or written out and edited."""

from __future__ import annotations

import json

from ..rules import BUILT_IN

_BY_LABEL = {r.label: r for r in BUILT_IN}
_HOST = r"\b(?:(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)\.)+(?:[a-zA-Z]{2,63})\b"
_URL = r"""https?://[^\s"'<>]+"""

#: Labels of built-in rules that the balanced preset has with the same pattern, in its order.
_SAME = ("gcp_api_key", "github_token", "github_pat", "openai_api_key", "anthropic_api_key", "stripe_key", "gitlab_token", "slack_token", "npm_token", "huggingface_token", "sendgrid_api_key", "twilio_account_sid")
_LAST = ("private_key_header", "jwt", "email", "ipv4", "ipv6_full", "url", "credential_url", "uuid", "image_digest", "mac_address", "user_home_path")
_RENAMED = {"github_pat": "github_pat_fine_grained"}
#: Patterns that a preset has instead of the built-in ones (fixed values).
_OTHER = {
    "aws_access_key_id": r"\b(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}\b",
    "secret_kv": r"""(?i)(?:api_key|api_secret|access_token|client_secret|private_key|secret_key|auth_key|signing_key|jwt_secret|jwt_key)[\s:="']+[A-Za-z0-9._~+/=-]{16,}""",
    "password_kv": r"""(?i)(?:password|passwd|pwd)[\s:="']+[^\s"']{6,}""",
    "credential_url": r"""[a-z][a-z0-9+.-]+://[^:@\s]{1,128}:[^@\s]{1,128}@[^\s"'<>]+""",
}


def _entry(label: str, category: str | None = None, pattern: str | None = None, **more) -> dict:
    rule = _BY_LABEL.get(_RENAMED.get(label, label))
    return {"pattern": pattern or _OTHER.get(label) or rule.pattern, "kind": "regex", "category": category or rule.category, "label": label, **more}


_BALANCED = [_entry(x) for x in ("aws_access_key_id", *_SAME, "secret_kv", "password_kv", *_LAST)]
#: By name (patterns, categories and labels are fixed values).
PRESETS: dict[str, list[dict]] = {
    "balanced": _BALANCED,
    "aggressive": [
        *_BALANCED,
        {"kind": "entropy", "category": "auth_token", "label": "high_entropy_token", "min_length": 20, "threshold": 4.5, "charset": "alphanumeric"},
        _entry("bearer_token", "auth_token", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}\b"),
        _entry("authorization_kv", "auth_token", r"""(?i)\bauthorization[\s:="']+[A-Za-z0-9._~+/=-]{16,}\b"""),
        _entry("container_id_short", "container_id", r"\b[a-f0-9]{12}\b"),
    ],
    "generic": [
        _entry("auth_token_context", "auth_token", r"(?i)\b(?:bearer|token|api[_-]?key|secret)[\s:=]+[A-Za-z0-9._~+/=-]{16,}\b"),
        _entry("jwt"),
        _entry("ipv4"),
        _entry("ipv6", "ipv6", r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b"),
        _entry("email"),
        _entry("hostname", "hostname", _HOST),
        _entry("url", "url", _URL),
        _entry("uuid"),
        _entry("container_id", "container_id", r"\b[a-f0-9]{12,64}\b"),
    ],
    "web": [
        _entry("jwt"),
        _entry("session_id", "auth_token", r"(?i)\bsess(?:ion)?[_-]?(?:id|token|key)[\s:=]+[A-Za-z0-9._~+/=-]{8,}\b"),
        _entry("oauth_token", "auth_token", r"(?i)(?:refresh|access)[_-]?token[\s:=]+[A-Za-z0-9._~+/=-]{16,}"),
        _entry("bearer_token", "auth_token", r"(?i)\b(?:bearer|authorization)[\s:]+[A-Za-z0-9._~+/=-]{16,}\b"),
        _entry("email"),
        _entry("client_ip", "ipv4", _BY_LABEL["ipv4"].pattern),
        _entry("url", "url", _URL),
    ],
    "k8s": [
        _entry("k8s_service_account_jwt", "jwt", _BY_LABEL["jwt"].pattern),
        _entry("k8s_token", "auth_token", r"(?i)token[\s:]+[A-Za-z0-9._~+/=-]{20,}"),
        _entry("k8s_namespace", "custom:k8s_namespace", r"\bnamespace[\s:]+[a-z][a-z0-9-]{2,62}\b"),
        _entry("pod_or_svc_ip", "ipv4", _BY_LABEL["ipv4"].pattern),
        _entry("k8s_dns", "hostname", _HOST),
        _entry("uid", "uuid", _BY_LABEL["uuid"].pattern),
        _entry("image_digest", "container_id", r"\b[a-f0-9]{64}\b"),
    ],
    "database": [
        _entry("db_connection_string", "url", r"""(?i)(?:postgres|mysql|mongodb|redis|amqp|jdbc:[^:]+)://[^\s"'>]+"""),
        _entry("db_password", "custom:db_password", r"""(?i)(?:password|passwd|pwd)[\s:=]+[^\s"']{6,}"""),
        _entry("db_username", "name", r"""(?i)(?:user|username|login)[\s:=]+[^\s"']{3,}"""),
        _entry("db_host_ip", "ipv4", _BY_LABEL["ipv4"].pattern),
        _entry("db_hostname", "hostname", _HOST),
        _entry("cert_fingerprint", "container_id", r"\b[a-f0-9]{40}\b"),
    ],
    "aws": [
        _entry("aws_access_key_id", "auth_token", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
        _entry("aws_arn", "aws_arn", r"\barn:aws:[^\s]+"),
        _entry("aws_account_id", "custom:aws_account_id", r"\b\d{12}\b"),
        _entry("s3_url", "url", r"""https://s3(?:[.-][a-z0-9-]+)?\.amazonaws\.com/[^\s"'<>]+"""),
        _entry("ec2_instance_id", "container_id", r"\bi-[0-9a-f]{8,17}\b"),
        _entry("ec2_ip", "ipv4", _BY_LABEL["ipv4"].pattern),
        _entry("email"),
    ],
}


def entries(name: str) -> list[dict]:
    """A preset's entries, for rule_files.compile_rules()."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
    return [dict(e) for e in PRESETS[name]]


def template(name: str) -> str:
    """A preset as the text of a YAML rule file (its strings are JSON ones, which YAML reads too)."""
    lines = [f"# Preset {name}. Remove what is not needed and add literals of your own."]
    for e in entries(name):
        lines += [("- " if k == 0 else "  ") + f"{key}: {json.dumps(value)}" for k, (key, value) in enumerate(e.items())]
    return "\n".join(lines) + "\n"
