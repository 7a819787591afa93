"""Queries of strategies, entropy replacement, escaped forms, inputs and reports, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strategies
from ..functions.replace import DEMO_KEY, _pad
from ..operators import aliases, inputs, report
from ..operators.entropy import CLASS, EntropyRule, redact_tokens

_TOKENS = EntropyRule(threshold=3.45)
_V = "concat(c_name, '.', cast(c_nationkey as {text}))"
_PATHS = ("concat('a/', c_name, '.log')", "concat('b/', c_mktsegment, '/x.tar.gz')", "concat('.git/', c_name)", "concat('c/', c_mktsegment)", "concat('b/', c_name, '.yaml')")


def _generator(letters: str, n: str) -> str:
    """SQL of n letters by the xorshift generator, over a table x(c_custkey, v, h); numbers wider than 64 bits are cut by a mask."""
    mask = "18446744073709551615::UHUGEINT"
    word = lambda i: "('0x' || " + " || ".join(f"substr(h, {16 * i + 2 * k + 1}, 2)" for k in range(7, -1, -1)) + ")::UBIGINT::UHUGEINT"
    a = f"xor(s, (s * 8192::UHUGEINT) & {mask})"
    b = f"xor(a, a // 128::UHUGEINT)"
    c = f"xor(b, (b * 131072::UHUGEINT) & {mask})"
    return f"""g AS (SELECT c_custkey, v, ({' + '.join(word(i) for i in range(4))}) & {mask} AS s, {n} AS n, 0 AS k, '' AS t FROM x
UNION ALL SELECT c_custkey, v, c, n, k + 1, t || substr('{letters}', (c % {len(letters)}::UHUGEINT)::BIGINT + 1, 1) FROM (SELECT *, {c} AS c FROM (SELECT *, {b} AS b FROM (SELECT *, {a} AS a FROM g WHERE k < n))))
SELECT c_custkey, v AS original, t AS sanitized FROM g WHERE k = n"""


def register(query: Callable, hmac: Callable[[str, str], str], email: Callable[[str, str], str], token: Callable[[str, str], str], byte: Callable[[str, str], str], by_file: tuple[Callable, str], locations: tuple[Callable, str]) -> None:
    """Adds the queries; the functions write SQL, the pairs are a query and its SQL."""
    x = f"x AS (SELECT c_custkey, v, {hmac('v', 'custom:demo')} AS h FROM (SELECT c_custkey, {_V.format(text='varchar')} AS v FROM customer))"
    ip = f"array_to_string(list_transform(string_split(v, ''), lambda c, i: CASE WHEN c = '.' THEN c ELSE ({byte('h', '(i - 1 - (length(left(v, i - 1)) - length(replace(left(v, i - 1), chr(46), chr(0)[2:]))))')} % 10)::VARCHAR END), '')"
    ip = ip.replace("chr(0)[2:]", "''")
    made = {
        "random_uuid": "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-4', substr(h, 14, 3), '-', translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 18, 3), '-', substr(h, 21, 12))",
        "fake_ip": ip,
        "hmac_hash": f"left(sha256(unhex('{_pad(DEMO_KEY, 0x5C)}') || unhex(sha256(unhex('{_pad(DEMO_KEY, 0x36)}') || encode(v)))), 32)",
        "category_aware": token("v", "h"),
    }
    sql = {n: f"WITH {x} SELECT c_custkey, v AS original, {m} AS sanitized FROM x" for n, m in made.items()}
    sql["random_string"] = f"WITH RECURSIVE {x}, " + _generator(strategies.MIXED, "16")
    sql["preserve_length"] = f"WITH RECURSIVE {x}, " + _generator(strategies.LOWER, "strlen(v)")

    for name, text in sql.items():

        def strategy(spark: SparkSession, sf_dir: str, name=name) -> DataFrame:
            v = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.expr(_V.format(text="string")).alias("original"))
            return v.select("c_custkey", "original", strategies.apply(name, F.col("original"), "custom:demo").alias("sanitized"))

        query(f"strategy_{name}", text)(strategy)

    cls = CLASS.replace("'", "''")

    @query(
        "entropy_redact",
        f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{cls}]+|[{cls}]+') AS ps FROM documents),
e AS (SELECT doc_id, k, ps[k] AS v FROM p, unnest(generate_series(1, len(ps))) AS t(k)),
c AS (SELECT doc_id, k, v, c, count(*) / length(v) AS q FROM (SELECT doc_id, k, v, unnest(string_split(v, '')) AS c FROM e WHERE regexp_full_match(v, '[A-Za-z0-9]+') AND length(v) BETWEEN 20 AND 200) GROUP BY doc_id, k, v, c),
n AS (SELECT doc_id, k, {token('v', hmac('v', 'auth_token'))} AS made FROM (SELECT doc_id, k, v FROM c GROUP BY doc_id, k, v HAVING sum(-q * log2(q)) >= 3.45)),
r AS (SELECT doc_id, string_agg(coalesce(made, v), '' ORDER BY k) AS sanitized, count(made) AS n_entropy FROM e LEFT JOIN n USING (doc_id, k) WHERE doc_id IN (SELECT doc_id FROM n) GROUP BY doc_id)
SELECT doc_id, coalesce(sanitized, text) AS sanitized, coalesce(n_entropy, 0)::BIGINT AS n_entropy FROM p LEFT JOIN r USING (doc_id)""",
    )
    def entropy_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return redact_tokens(docs, "text", [_TOKENS]).select("doc_id", "sanitized", "n_entropy")

    @query(
        "escaped_forms",
        "WITH v AS (SELECT c_custkey, concat('a\"', c_name, chr(10), '<&>''\\', chr(1)) AS v FROM customer), "
        "w AS (SELECT c_custkey, v, replace(replace(replace(v, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') AS y, replace(replace(v, '&', '&amp;'), '<', '&lt;') AS m FROM v) "
        "SELECT DISTINCT c_custkey, f AS form FROM (SELECT c_custkey, unnest([replace(y, chr(1), '\\u0001'), y, m, replace(m, '\"', '&quot;'), replace(m, '''', '&apos;'), replace(replace(replace(m, '>', '&gt;'), '\"', '&quot;'), '''', '&apos;'), replace(v, '\"', '\"\"')]) AS f FROM w)",
    )
    def escaped_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.concat(F.lit('a"'), "c_name", F.lit("\n<&>'\\\x01"))
        return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.explode(aliases.forms(v)).alias("form"))

    paths = " UNION ALL ".join(f"SELECT c_custkey, {p} AS path FROM customer" for p in _PATHS)

    def made_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = spark.read.parquet(f"{sf_dir}/customer.parquet")
        return one.select("c_custkey", F.explode(F.array(*(F.expr(p) for p in _PATHS))).alias("path"))

    @query("input_selection", f"SELECT c_custkey, path, CASE WHEN ends_with(path, '.log') THEN 'log' WHEN ends_with(path, '.tar.gz') THEN 'tar.gz' WHEN ends_with(path, '.yaml') THEN 'yaml' ELSE 'text' END AS format FROM ({paths}) WHERE NOT starts_with(path, '.git/') AND (starts_with(path, 'b/') OR ends_with(path, '.log')) AND NOT path LIKE 'b/BUILDING/%'")
    def input_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = F.col("path")
        keep = inputs.walkable(p) & inputs.selected(p, ("b/", "*.log"), ("b/BUILDING/*",))
        return made_paths(spark, sf_dir).where(keep).select("c_custkey", "path", inputs.format_of(p).alias("format"))

    @query("archive_entry_filter", f"SELECT c_custkey, path FROM ({paths}) WHERE (regexp_full_match(path, 'a/[^/]*\\.log') OR starts_with(path, 'b/')) AND NOT regexp_full_match(path, '(.*/)?x\\.tar\\..*')")
    def archive_entry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
        keep = inputs.selected(F.col("path"), ("a/*.log", "b/"), ("**/x.tar.*",), inputs.entry_matches)
        return made_paths(spark, sf_dir).where(keep)

    named = f"SELECT DISTINCT path, CASE WHEN ends_with(path, '.tar.gz') THEN replace(path, '.tar.gz', '.sanitized.tar.gz') WHEN contains(path, '.') AND NOT starts_with(path, '.git') THEN regexp_replace(path, '\\.([a-z]+)$', '-sanitized.\\1') ELSE path || '-sanitized' END AS output FROM ({paths})"

    @query("output_names", named)
    def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inputs.output_names(made_paths(spark, sf_dir).select("path").distinct(), "path")

    @query("binary_skip", "SELECT c_custkey, c_custkey % 3 <> 0 AS is_binary FROM customer")
    def binary_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = F.pmod("c_custkey", F.lit(3))
        raw = F.when(n == 0, F.encode("c_name", "UTF-8")).when(n == 1, F.unhex(F.lit("4100"))).otherwise(F.unhex(F.lit("4101024243")))
        return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", inputs.looks_binary(raw).alias("is_binary"))

    results = f"SELECT doc_id::VARCHAR AS uri, pattern AS rule_id, CASE WHEN pattern IN ('email', 'name', 'phone', 'credit_card', 'ssn', 'auth_token', 'jwt') THEN 'error' ELSE 'warning' END AS level, matches || ' sensitive value(s) of type ''' || pattern || ''' detected and sanitized.' AS message, start_line FROM ({by_file[1]}) JOIN (SELECT doc_id, pattern, arg_min(line, byte_offset) AS start_line FROM ({locations[1]}) GROUP BY doc_id, pattern) USING (doc_id, pattern)"

    @query("sarif_results", results)
    def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report.sarif_results(by_file[0](spark, sf_dir), "doc_id", locations[0](spark, sf_dir))

    @query("redaction_line", f"SELECT doc_id, string_agg(pattern || ' (' || matches || ')', ', ' ORDER BY matches DESC, pattern) AS line FROM ({by_file[1]}) GROUP BY doc_id")
    def redaction_line(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report.redaction_line(by_file[0](spark, sf_dir), "doc_id")

    @query("fail_on_match", f"SELECT count(*) > 0 AS failed, CASE WHEN count(*) > 0 THEN 2 ELSE 0 END AS exit_code FROM ({by_file[1]})")
    def fail_on_match(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report.fail_on_match(by_file[0](spark, sf_dir))
