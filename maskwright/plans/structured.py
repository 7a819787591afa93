"""Queries of the format readers, field rules, signals and propagation over texts made of customer columns.

Each text is a template: ``{mail}``, ``{key}`` and ``{seg}`` stand for the row's
values. The SQL fills the same template with the replaced values, so it knows
nothing of readers or rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields, propagate
from ..operators.fields import FieldRule

VALUES = {"mail": "concat(lower(replace(c_name, '#', '.')), '@corp.example')", "key": "concat('k', md5(c_name))", "seg": "c_mktsegment", "tok": "concat('abcdefghijklmnopqrstuv-', cast(c_custkey as {text}))", "no": "cast(c_custkey as {text})"}
RULES = (FieldRule("*email", "email"), FieldRule("*.api_key", "auth_token", min_length=8), FieldRule("account", "custom:account"))

#: format: (text, what it becomes, options). In the second, {=x} is the replacement of x.
TEMPLATES: dict[str, tuple[str, str, dict]] = {
    "json": ('{"user": {"email": "{mail}", "api_key" : "{key}", "segment": "{seg}"}, "account": {no}, "tags": [{"email": "{mail}"}, true]}', '{"user": {"email": "{=mail}", "api_key" : "{=key}", "segment": "{seg}"}, "account": "{=no}", "tags": [{"email": "{=mail}"}, true]}', {}),
    "jsonl": ('{"email":"{mail}"}\nnot json {"email"\n\n{"db":{"api_key":"{key}"},"account":{no}}\n', '{"email":"{=mail}"}\nnot json {"email"\n\n{"db":{"api_key":"{=key}"},"account":"{=no}"}\n', {}),
    "yaml": ('# {seg}\nuser:\n  email: {mail}\n  api_key: "{key}"\n  more:\n    - email: \'{mail}\'\naccount: {no} # kept\nnote: |\n  {seg}\n', '# {seg}\nuser:\n  email: "{=mail}"\n  api_key: "{=key}"\n  more:\n    - email: \'{=mail}\'\naccount: "{=no}" # kept\nnote: |\n  {seg}\n', {}),
    "toml": ('account = {no} # kept\n[svc]\nemail = "{mail}"\n[svc.db]\napi_key = \'{key}\'\nlist = ["{seg}", "b"]\nuser = { email = "{mail}", n = 1 }\n', 'account = "{=no}" # kept\n[svc]\nemail = "{=mail}"\n[svc.db]\napi_key = \'{=key}\'\nlist = ["{seg}", "b"]\nuser = { email = "{=mail}", n = 1 }\n', {}),
    "xml": ('<?xml version="1.0"?>\n<c><!-- {seg} --><email>{mail}</email><k a="{seg}" email="{mail}"/><d><![CDATA[{seg}]]></d></c>', '<?xml version="1.0"?>\n<c><!-- {seg} --><email>{=mail}</email><k a="{seg}" email="{=mail}"/><d><![CDATA[{seg}]]></d></c>', {}),
    "csv": ('id,email,"db.api_key",account\r\n1,{mail},"{key}",{no}\r\n2,,"a ""q"", b",\r\n', 'id,email,"db.api_key",account\r\n1,{=mail},"{=key}",{=no}\r\n2,,"{Q}",\r\n', {}),
    "tsv": ("email\tseg\n{mail}\t{seg}\n", "{=mail}\t{seg}\n", {"has_header": False}),
    "env": ('# {seg}\nexport work_email="{mail}"\nSEG={seg}\naccount={no} # gone\n', '# {seg}\nexport work_email="{=mail}"\nSEG={seg}\naccount={=no}\n', {}),
    "ini": ("account = {no} ; gone\n[db]\n; {seg}\napi_key: {key}\nemail = {mail}\nseg={seg}\n", "account = {=no}\n[db]\n; {seg}\napi_key: {=key}\nemail = {=mail}\nseg={seg}\n", {}),
    "key_value": ("seg = '{seg}'\n# work_email = \"{mail}\"\nx.api_key = '{key}',\naccount = <<~EOS\n{seg}\nEOS\nlast = 1\n", "seg = '{seg}'\n# work_email = \"{=mail}\"\nx.api_key = '{=key}',\naccount = <<~EOS\n{=acc}\nEOS\nlast = 1\n", {}),
    "log": ('{seg} start\nINFO {"email": "{mail}", "a": {"b": "}"}} end {seg}\nbad {"email": \n', '{seg} start\nINFO {"email": "{=mail}", "a": {"b": "}"}} end {seg}\nbad {"email": \n', {}),
    "command_output": ("{seg}\n> account\n\n{seg}\n> other\n{seg}\n----\n{seg}\n", "{seg}\n> account\n\n{=acc}\n> other\n{seg}\n----\n{seg}\n", {}),
    "columns": ("{seg} {seg}\nid  email  seg\n1   {mail}  {seg}\nshort row\n2 {mail} {seg} more\n", "{seg} {seg}\nid  email  seg\n1   {=mail}  {seg}\nshort row\n2 {=mail} {seg} more\n", {"header": "email"}),
}
#: Without a header the columns are numbers, so this one's rule is on the first.
TSV_RULES = (FieldRule("0", "email"),)


def _concat(template: str, column: Callable[[str], str]) -> str:
    parts = re.split(r"\{(=?\w+)\}", template)
    text = lambda s: "'" + s.replace("'", "''").replace("\n", "\x01") + "'"
    each = [text(p) if k % 2 == 0 else column(p) for k, p in enumerate(parts) if k % 2 or p]
    return f"replace(concat({', '.join(each)}), chr(1), chr(10))"


def _made(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    values = [F.expr(e.format(text="string")).alias(n) for n, e in VALUES.items()]
    escaped = template.replace("\\", "\\\\")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", *values).select("c_custkey", F.expr(_concat(escaped, lambda n: n)).alias("text"))


def register(query: Callable, hmac: Callable[[str, str], str], email: Callable[[str, str], str], token: Callable[[str, str], str]) -> None:
    """Adds the queries; the functions write the SQL of the hash and of two replacements."""
    new = {"mail": email("mail", hmac("mail", "email")), "key": token("key", hmac("key", "auth_token")), "no": token("no", hmac("no", "custom:account")), "acc": token("seg", hmac("seg", "custom:account")), "quoted": token("q", hmac("q", "auth_token"))}
    values = ", ".join(f"{e.format(text='varchar')} AS {n}" for n, e in VALUES.items())
    base = f"WITH a AS (SELECT c_custkey, 'a \"q\", b' AS q, {values} FROM customer), x AS (SELECT *, {', '.join(f'{e} AS new_{n}' for n, e in new.items())} FROM a)"

    def column(n: str) -> str:
        return "new_quoted" if n == "Q" else f"new_{n[1:]}" if n[0] == "=" else n

    for fmt, (before, after, options) in TEMPLATES.items():
        rules = TSV_RULES if fmt == "tsv" else RULES
        text = before.split("\n", 1)[1] if fmt == "tsv" else before

        def run(spark: SparkSession, sf_dir: str, fmt=fmt, text=text, rules=rules, options=options) -> DataFrame:
            out = fields.redact_fields(_made(spark, sf_dir, text), "text", fmt, rules, **options)
            return out.select("c_custkey", "sanitized", F.size("edits").cast("long").alias("n_edits"))

        n = len(re.findall(r"\{=|\{Q\}", after))
        query(f"{fmt}_redact", f"{base} SELECT c_custkey, {_concat(after, column)} AS sanitized, {n}::BIGINT AS n_edits FROM x")(run)

    signal_text = '{"password": "{key}", "note": "{key}", "db": {"secret": "aaaaaaaaaaaa", "token": "{tok}", "password_hash": "{key}", "clientSecret": "{key}", "csrf-token": "abcdefghij"}, "short_secret": "ab", "key": "{tok}"}'
    signal_done = '{"password": "{=cred}", "note": "{key}", "db": {"secret": "aaaaaaaaaaaa", "token": "{=tok}", "password_hash": "{=cred}", "clientSecret": "{=cred}", "csrf-token": "abcdefghij"}, "short_secret": "ab", "key": "{tok}"}'
    cred = f"{base}, y AS (SELECT *, {token('key', hmac('key', 'custom:credential'))} AS new_cred, {token('tok', hmac('tok', 'custom:credential'))} AS new_tok FROM x)"

    @query("field_signal_json", f"{cred} SELECT c_custkey, {_concat(signal_done, column)} AS sanitized FROM y")
    def field_signal_json(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fields.redact_fields(_made(spark, sf_dir, signal_text), "text", "json", (), fields.SIGNALS).select("c_custkey", "sanitized")

    def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = [fields.dictionary(fields.redact_fields(_made(spark, sf_dir, TEMPLATES[f][0]), "text", f, RULES), RULES) for f in ("json", "env")]
        return parts[0].union(parts[1]).distinct()

    known = "SELECT 'email' AS category, mail AS original FROM x UNION SELECT 'auth_token', key FROM x UNION SELECT 'custom:account', no FROM x"

    @query("discovery_dictionary", f"{base} {known}")
    def discovery_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
        return discovered(spark, sf_dir)

    @query("propagate_cross_source", f"{base} SELECT c_custkey, concat('mail to ', new_mail, ' with ', new_key, '; ', seg, ' stays') AS sanitized FROM x")
    def propagate_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = discovered(spark, sf_dir).where("category != 'custom:account'")
        return propagate.redact_known(_made(spark, sf_dir, "mail to {mail} with {key}; {seg} stays"), "text", found).select("c_custkey", "sanitized")

    @query("handoff_new_literals", f"{base} SELECT category, original FROM ({known}) WHERE strlen(original) >= 4 AND original NOT IN (SELECT mail FROM x WHERE c_custkey % 2 = 0)")
    def handoff_new_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = _made(spark, sf_dir, "{mail}").where("c_custkey % 2 = 0").select(F.col("text").alias("pattern"))
        return propagate.new_literals(discovered(spark, sf_dir), rules)
