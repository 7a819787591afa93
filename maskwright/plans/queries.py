"""The engine's queries over the driver's tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.replace import DEMO_KEY, TOKEN_HEAD, TOKEN_TAIL, hmac_parts, replace
from ..operators import report, scan, textutil
from ..rules import BUILT_IN, BUILT_IN_ALLOWED, Rule, cut_at_group
from . import extra, more, structured
from .shapes import kept, shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TEXTS = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "conversations": ("conv_id", "text")}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The table dealt to all cores where a few files' row groups would leave most of them idle; a table of many splits as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if "text" not in df.columns and "html" not in df.columns or len(df.inputFiles()) >= n else df.repartition(n)


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _sql(s: str) -> str:
    return s.replace("'", "''")


def _hmac(value: str, category: str) -> str:
    inner, outer = hmac_parts(DEMO_KEY, category)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


def _hex(h: str, n: str) -> str:
    return f"left(repeat({h}, ({n} // 64 + 1)::BIGINT), greatest({n}, 0))"


def _byte(h: str, i: str) -> str:
    return f"('0x' || substr({h}, ((({i}) % 32) * 2 + 1)::BIGINT, 2))::INTEGER"


def _email(v: str, h: str) -> str:
    d = f"(CASE WHEN contains({v}, '@') THEN regexp_extract({v}, '[^@]*$') ELSE 'x.co' END)"
    n = f"(strlen({v}) - 1 - strlen({d}))"
    return f"CASE WHEN {n} <= 0 THEN {_hex(h, f'strlen({v})')} ELSE {_hex(h, n)} || '@' || {d} END"


def _ipv4(v: str, h: str) -> str:
    w = f"({_byte(h, '(i - 1) * 2')} * 256 + {_byte(h, '(i - 1) * 2 + 1')})"
    span = lambda lo, hi: f"({lo} + {w} % {hi - lo + 1})::VARCHAR"
    return f"array_to_string(list_transform(string_split({v}, '.'), lambda p, i: CASE length(p) WHEN 1 THEN {span(0, 9)} WHEN 2 THEN {span(10, 99)} ELSE {span(100, 255)} END), '.')"


def _folded(v: str, h: str, cls: str, draw: str) -> str:
    """draw over b (the byte), c (the character) and k (hits before it); values always hold a hit here."""
    k = f"(length(regexp_replace(left({v}, i - 1), '[^{cls}]', '', 'g')))"
    expr = draw.replace("$b", _byte(h, k)).replace("$k", k)
    return f"array_to_string(list_transform(string_split({v}, ''), lambda c, i: CASE WHEN regexp_matches(c, '[{cls}]') THEN {expr} ELSE c END), '')"


def _token(v: str, h: str) -> str:
    n = f"(strlen({v}) - {len(TOKEN_HEAD) + len(TOKEN_TAIL)})"
    return f"CASE WHEN {n} <= 0 THEN {_hex(h, f'strlen({v})')} ELSE '{TOKEN_HEAD}' || {_hex(h, n)} || '{TOKEN_TAIL}' END"


#: By category: a value made of customer columns (the same in both engines), and the SQL of its replacement from v and h.
_DIGIT = "(($b) % 10)::VARCHAR"
_NIBBLE = "CASE WHEN regexp_matches(c, '[A-F]') THEN upper(to_hex(($b) % 16)) ELSE lower(to_hex(($b) % 16)) END"
SHAPES = {
    "email": ("concat(lower(replace(c_name, '#', '.')), '@corp', cast(c_nationkey as {text}), '.example')", _email("v", "h")),
    "ipv4": ("concat('10.', cast(c_nationkey as {text}), '.', cast(c_custkey % 256 as {text}), '.', cast(c_custkey % 7 as {text}))", _ipv4("v", "h")),
    "phone": ("concat('+', cast(c_nationkey + 10 as {text}), ' (555) ', substr(c_name, 10, 9))", _folded("v", "h", "0-9", _DIGIT)),
    "credit_card": ("concat('4111-', substr(c_name, 11, 4), '-', substr(c_name, 15, 4), '-0000')", _folded("v", "h", "0-9", _DIGIT)),
    "ssn": ("concat(substr(c_name, 10, 3), '-', substr(c_name, 13, 2), '-', substr(c_name, 15, 4))", _folded("v", "h", "0-9", f"CASE WHEN $k < 3 THEN '0' ELSE ({_byte('h', '$k - 3')} % 10)::VARCHAR END")),
    "uuid": ("concat(substr(md5(c_name), 1, 8), '-', upper(substr(md5(c_name), 9, 4)), '-4', substr(md5(c_name), 13, 3), '-a', substr(md5(c_name), 16, 3), '-', substr(md5(c_name), 19, 12))", _folded("v", "h", "0-9a-fA-F", _NIBBLE)),
    "ipv6": ("concat('2001:db8::', substr(md5(c_name), 1, 4), ':', substr(md5(c_name), 5, 4))", _folded("v", "h", "0-9a-fA-F", _NIBBLE)),
    "mac_address": ("concat(substr(md5(c_name), 1, 2), ':', substr(md5(c_name), 3, 2), ':', substr(md5(c_name), 5, 2), ':0A:0B:0C')", _folded("v", "h", "0-9a-fA-F", _NIBBLE)),
    "container_id": ("concat('sha256:', md5(c_name), md5(c_mktsegment))", _folded("v", "h", "0-9a-fA-F", _NIBBLE)),
    "auth_token": ("concat('tok_', md5(c_name))", _token("v", "h")),
    "custom:password": ("concat(c_mktsegment, substr(md5(c_name), 1, c_nationkey))", _token("v", "h")),
}


def _replacement(category: str, value: str, made: str) -> None:
    name = "replace_" + category.replace("custom:", "custom_")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = _read(spark, sf_dir, "customer").select("c_custkey", F.expr(value.format(text="string")).alias("original"))
        return v.select("c_custkey", "original", replace(F.col("original"), category).alias("sanitized"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH x AS (SELECT c_custkey, {value.format(text='varchar')} AS v FROM customer), y AS (SELECT *, {_hmac('v', category)} AS h FROM x) SELECT c_custkey, v AS original, {made} AS sanitized FROM y"


for _c, (_v, _m) in (SHAPES | shapes(_byte)).items():
    _replacement(_c, _v, _m)

#: By category: the SQL of a built-in rule's replacement from v and h.
_HEX_SIGN = "substr(h, (($k) % 64 + 1)::BIGINT, 1)"
_SCHEME = "regexp_extract(v, '^[A-Za-z0-9+.-]*://')"
_BEHIND = f"substr(v, length({_SCHEME}) + 1)"
_MADE = {c: m for c, (_, m) in SHAPES.items()} | {
    "jwt": shapes(_byte)["jwt"][1],
    "file_path": kept("v", "[/]", _HEX_SIGN),
    "aws_arn": kept("v", "[:/]", _HEX_SIGN),
    "hostname": shapes(_byte)["hostname"][1].replace(" || ':8443'", ""),
    "name": shapes(_byte)["name"][1],
    "url": f"{_SCHEME} || CASE WHEN regexp_full_match({_BEHIND}, '[/:?=&#@.]*') THEN {_hex('h', f'strlen({_BEHIND})')} ELSE {kept(_BEHIND, '[/:?=&#@.]', _HEX_SIGN)} END",
}


def allowed_sql(v: str) -> str:
    """Whether the built-in allow list has v."""
    exact = ", ".join(f"'{_sql(p)}'" for p in BUILT_IN_ALLOWED if "*" not in p)
    globs = [p.split("*") for p in BUILT_IN_ALLOWED if "*" in p]
    return f"(lower({v}) IN ({exact})" + "".join(f" OR (starts_with(lower({v}), '{a}') AND ends_with(lower({v}), '{b}') AND length({v}) >= {len(a) + len(b)})" for a, b in globs) + ")"


def selected_sql(table: str, id_: str, text: str, rules: tuple[Rule, ...] = BUILT_IN) -> str:
    """CTEs x(id, text) and sel(id, k, start, stop, rule, hit, before, v, rest, category, label): the selected matches of a table's texts."""
    each = []
    for k, r in enumerate(rules):
        whole = _sql(r.plain)
        if r.has_group:
            flags, before, group, behind = (_sql(p) for p in cut_at_group(r.plain))
            own = f"regexp_extract_all(text, '{flags}({before})({group}){behind}', 1) AS befores, regexp_extract_all(text, '{flags}({before})({group}){behind}', 2) AS vs"
        else:
            own = f"NULL::VARCHAR[] AS befores, regexp_extract_all(text, '{whole}') AS vs"
        least, most = r.min_length or 0, (1 << 31) - 1 if r.max_length is None else r.max_length
        each.append(f"SELECT id, {k} AS rule, {int(r.kind != 'literal')} AS kind, {least} AS least, {most} AS most, '{_sql(r.category)}' AS category, '{r.label}' AS label, regexp_extract_all(text, '{whole}') AS hits, {own}, regexp_split_to_array(text, '{whole}') AS gaps FROM x WHERE regexp_matches(text, '{whole}')")
    rows = " UNION ALL ".join(each)
    return f"""x AS (SELECT {id_} AS id, coalesce({text}, '') AS text FROM {table}), raw AS ({rows}),
hit AS (SELECT id, rule, kind, category, label, hits[i] AS hit, coalesce(befores[i], '') AS before, vs[i] AS v, (list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda g: length(g))), 0))::BIGINT AS start FROM raw, unnest(generate_series(1, len(hits))) AS t(i) WHERE strlen(hits[i]) BETWEEN least AND most),
listed AS (SELECT id, list(struct_pack(start := start, stop := start + length(hit), rule := rule, hit := hit, before := before, v := v, category := category, label := label) ORDER BY start, length(hit) DESC, kind, rule) AS ms FROM hit GROUP BY id),
picked AS (SELECT id, list_reduce(list_transform(ms, lambda m: [m]), lambda acc, m: CASE WHEN m[1].start >= acc[-1].stop THEN list_concat(acc, m) ELSE acc END) AS ms FROM listed),
sel AS (SELECT id, k, ms[k].start AS start, ms[k].stop AS stop, CASE WHEN k > 1 THEN ms[k - 1].stop ELSE 0 END AS past, ms[k].rule AS rule, ms[k].hit AS hit, ms[k].before AS before, ms[k].v AS v, ms[k].category AS category, ms[k].label AS label FROM picked, unnest(generate_series(1, len(ms))) AS t(k))"""


def redacted_sql(table: str, id_: str, text: str, rules: tuple[Rule, ...] = BUILT_IN, allow: bool = True) -> str:
    """CTEs up to done(id, sanitized, n): the texts with the selected matches replaced."""
    categories = dict.fromkeys(r.category for r in rules)
    hashed = "CASE category " + " ".join(f"WHEN '{_sql(c)}' THEN {_hmac('v', c)}" for c in categories) + " END"
    made = "CASE " + (f"WHEN {allowed_sql('v')} THEN v " if allow else "") + r"WHEN regexp_full_match(v, '\*{3,}|•{3,}|#{3,}') OR v = '' THEN v " + " ".join(f"WHEN category = '{_sql(c)}' THEN {_MADE.get(c) or _token('v', 'h')}" for c in categories) + " END"
    return f"""{selected_sql(table, id_, text, rules)},
new AS (SELECT *, {made} AS made FROM (SELECT *, {hashed} AS h FROM sel)),
joined AS (SELECT id, max(stop) AS past, count(*) AS n, string_agg(substr(text, past + 1, start - past) || before || made || substr(hit, length(before) + length(v) + 1), '' ORDER BY k) AS head FROM new JOIN x USING (id) GROUP BY id),
done AS (SELECT id, CASE WHEN n IS NULL THEN text ELSE head || substr(text, past + 1) END AS sanitized, coalesce(n, 0)::BIGINT AS n FROM x LEFT JOIN joined USING (id))"""


_SELECTED = "WITH " + selected_sql("documents", "doc_id", "text")


def stays(value: Column) -> Column:
    """Whether the built-in allow list has a value."""
    return textutil.is_allowed(value, BUILT_IN_ALLOWED)


def _redact_table(name: str, table: str, id_: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = scan.redact(_read(spark, sf_dir, table).select(id_, text), text, BUILT_IN, allowed=stays)
        return out.select(id_, "sanitized", F.size("matches").cast("long").alias("n_matches"))

    query(name, f"WITH {redacted_sql(table, id_, text)} SELECT id AS {id_}, sanitized, n AS n_matches FROM done")(run)


_redact_table("scan_redact_documents", "documents", "doc_id", "text")
_redact_table("scan_redact_pages", "pages", "page_id", "html")


@query("report_by_file", f"{_SELECTED} SELECT id AS doc_id, label AS pattern, count(*) AS matches FROM sel GROUP BY 1, 2")
def report_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.counts(_read(spark, sf_dir, "documents"), "doc_id", "text", BUILT_IN)


@query("report_summary", f"SELECT pattern, count(*) AS files, sum(matches)::BIGINT AS matches FROM ({ORACLES['report_by_file']}) GROUP BY 1")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(report_by_file(spark, sf_dir))


_LEVEL = "CASE WHEN pattern IN (" + ", ".join(f"'{e}'" for e in report.ERRORS) + ") THEN 'error' ELSE 'warning' END"


@query("sarif_rules", f"SELECT DISTINCT pattern AS id, array_to_string(list_transform(string_split(replace(replace(pattern, ':', '_'), '-', '_'), '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS name, {_LEVEL} AS level FROM ({ORACLES['report_by_file']})")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rules(report_by_file(spark, sf_dir))


@query(
    "findings_ndjson",
    f"""SELECT doc_id, '{{"path":"' || doc_id || '","matches":' || sum(matches)::BIGINT || ',"patterns":{{' || string_agg('"' || pattern || '":' || matches, ',' ORDER BY pattern) || '}}}}' AS line FROM ({ORACLES['report_by_file']}) GROUP BY doc_id""",
)
def findings_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ndjson(report_by_file(spark, sf_dir), "doc_id")


@query(
    "match_locations",
    f"{_SELECTED} SELECT id AS doc_id, (length(left(text, start)) - length(replace(left(text, start), chr(10), '')) + 1)::BIGINT AS line, strlen(left(text, start))::BIGINT AS byte_offset, label AS pattern FROM sel JOIN x USING (id)",
)
def match_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.locations(_read(spark, sf_dir, "documents"), "doc_id", "text", BUILT_IN)


@query("store_dictionary", f"{_SELECTED} SELECT DISTINCT category, v AS original FROM sel WHERE NOT {allowed_sql('v')}")
def store_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.dictionary(_read(spark, sf_dir, "documents"), "text", BUILT_IN, allowed=stays)


def _counting(table: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan.totals(_read(spark, sf_dir, table), text, BUILT_IN)

    QUERIES[f"scan_counts_{table}"] = run
    ORACLES[f"scan_counts_{table}"] = " UNION ALL ".join(f"SELECT '{r.label}' AS pattern, coalesce(sum(len(regexp_extract_all(coalesce({text}, ''), '{_sql(r.pattern)}'))), 0)::BIGINT AS matches FROM {table}" for r in BUILT_IN)


for _t, (_, _x) in TEXTS.items():
    _counting(_t, _x)

_VALUES = "(SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'LocalHost' WHEN 1 THEN 'https://example.com/' || c_name WHEN 2 THEN '${' || c_mktsegment || '}' WHEN 3 THEN c_name WHEN 4 THEN '127.0.0.1' ELSE 'example' || c_nationkey END AS value FROM customer)"


@query(
    "allow_test",
    f"SELECT c_custkey, value, CASE WHEN lower(value) IN ('localhost', '127.0.0.1') THEN lower(value) WHEN starts_with(value, 'https://example.com') THEN 'https://example.com*' WHEN starts_with(value, '${{') AND ends_with(value, '}}') THEN '${{*}}' END AS matched FROM {_VALUES}",
)
def allow_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pmod("c_custkey", F.lit(6))
    value = F.when(n == 0, "LocalHost").when(n == 1, F.concat(F.lit("https://example.com/"), "c_name")).when(n == 2, F.concat(F.lit("${"), "c_mktsegment", F.lit("}"))).when(n == 3, F.col("c_name")).when(n == 4, "127.0.0.1").otherwise(F.concat(F.lit("example"), F.col("c_nationkey").cast("string")))
    v = _read(spark, sf_dir, "customer").select("c_custkey", value.alias("value"))
    return v.select("c_custkey", "value", textutil.allowed(F.col("value"), BUILT_IN_ALLOWED).alias("matched"))


_LINES = "concat('# ', c_mktsegment, chr(10), 'name=', c_name, chr(10), chr(10), '  token = ', md5(c_name), '=x', chr(10), 'plain ', c_mktsegment)"


@query("strip_values", "SELECT c_custkey, concat('# ', c_mktsegment, chr(10), 'name=', chr(10), chr(10), '  token =', chr(10), 'plain ', c_mktsegment, chr(10)) AS stripped FROM customer")
def strip_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", textutil.strip_values(F.expr(_LINES)).alias("stripped"))


_CLASS = "[" + "".join("\\" + c for c in textutil.DELIMITERS if c not in " \t\r\n") + "\\s]+"


@query(
    "entropy_tokens",
    f"""WITH t AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{_sql(_CLASS)}')) AS token FROM documents) WHERE regexp_full_match(token, '[A-Za-z0-9]+') AND length(token) BETWEEN 20 AND 200),
c AS (SELECT doc_id, token, c, count(*) / length(token) AS p FROM (SELECT doc_id, token, unnest(string_split(token, '')) AS c FROM t) GROUP BY doc_id, token, c)
SELECT doc_id, token, round(sum(-p * log2(p)), 6) AS bits FROM c GROUP BY doc_id, token""",
)
def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textutil.entropy_tokens(_read(spark, sf_dir, "documents"), "doc_id", "text")


@query("entropy_histogram", " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (bits >= {t}) AS candidates FROM e" for t in (3.0, 3.5, 4.0, 4.5, 5.0, 5.5)).join((f"WITH e AS ({ORACLES['entropy_tokens']}) ", "")))
def entropy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = (3.0, 3.5, 4.0, 4.5, 5.0, 5.5)
    sums = entropy_tokens(spark, sf_dir).agg(*(F.count(F.when(F.col("bits") >= t, 1)).alias(f"c{k}") for k, t in enumerate(steps)))
    return sums.select(F.explode(F.arrays_zip(F.array(*(F.lit(t) for t in steps)).alias("threshold"), F.array(*(f"c{k}" for k in range(len(steps)))).alias("candidates"))).alias("x")).select(F.col("x.threshold").alias("threshold"), F.col("x.candidates").alias("candidates"))


_KEYWORDS = ("inter", "ation", "que")


@query(
    "log_context",
    """WITH l AS (SELECT doc_id, k AS line_number, s[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(generate_series(1, len(s))) AS t(k)),
w AS (SELECT doc_id, line_number, line, CASE WHEN contains(lower(line), 'inter') THEN 'inter' WHEN contains(lower(line), 'ation') THEN 'ation' WHEN contains(lower(line), 'que') THEN 'que' END AS keyword,
coalesce(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
coalesce(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM l)
SELECT doc_id, line_number, keyword, line, before, after, n > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM w WHERE keyword IS NOT NULL) WHERE r <= 5""",
)
def log_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textutil.log_context(_read(spark, sf_dir, "documents"), "doc_id", "text", _KEYWORDS, around=2, cap=5)


@query("archive_entry_names", "SELECT c_custkey, 'etc/' || c_name || '/a.txt' AS entry FROM customer")
def archive_entry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("C:\\..\\etc\\./"), "c_name", F.lit("//../a.txt"))
    return _read(spark, sf_dir, "customer").select("c_custkey", textutil.safe_entry_name(raw).alias("entry"))


structured.register(query, _hmac, _email, _token)
more.register(query, _hmac, _email, _token, _byte, (report_by_file, ORACLES["report_by_file"]), (match_locations, ORACLES["match_locations"]))
extra.register(query, extra.Sql(_hmac, _email, _token, _byte, _hex, selected_sql, redacted_sql, allowed_sql))
