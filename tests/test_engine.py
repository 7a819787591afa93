"""Archives, rule files, profiles, streams and strategies on small inputs."""

import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.functions import strategies
from maskwright.functions.replace import DEMO_KEY
from maskwright.operators import aliases, inputs, profiles, report, scan, textutil
from maskwright.operators.entropy import EntropyRule, redact_tokens
from maskwright.operators.fields import FieldRule
from maskwright.rules import BUILT_IN
from maskwright.sources import archives, rule_files
from maskwright.streaming import scans


def tarred(files, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def test_archives_there_and_back(spark):
    inner = tarred([("deep.txt", b"jo@corp.example"), ("b/c.txt", b"x")], "w:gz")
    rows = [("a.zip", zipped([("../x.txt", b"one"), ("in.tar.gz", inner), ("fake.zip", b"no zip"), ("é.txt", b"")])), ("b.tar", tarred([("f", b"2")])), ("c.log.gz", gzip.compress(b"line")), ("bad.tgz", b"??"), ("n.zip", None), (None, b"x"), ("plain.txt", b"x")]
    df = spark.createDataFrame(rows, "path string, content binary")
    found = archives.entries(df)
    got = {(r.archive, r.entry): (bytes(r.content), r.depth, r.safe_entry) for r in found.collect()}
    assert got[("a.zip", "in.tar.gz!deep.txt")] == (b"jo@corp.example", 2, "in.tar.gz!deep.txt")
    assert got[("a.zip", "../x.txt")] == (b"one", 1, "x.txt") and got[("a.zip", "fake.zip")][0] == b"no zip" and got[("c.log.gz", "c.log")][0] == b"line"
    assert got[("bad.tgz", "")][0] == b"??" and len(got) == 8
    again = {(r.archive, r.entry): (bytes(r.content), r.depth, r.safe_entry) for r in archives.entries(archives.rebuild(found).withColumnRenamed("archive", "path")).collect()}
    assert again == got
    with pytest.raises(Exception, match="nested deeper"):
        archives.entries(df, depth=1).count()
    assert archives.entries(df.limit(0)).count() == 0


def test_rule_files():
    text = '[{"kind": "regex", "pattern": "k-[0-9]+", "category": "auth_token", "label": "k"}, {"kind": "literal", "pattern": "acme", "category": "site"}, {"kind": "allow", "values": ["localhost", "*.example"]}, {"kind": "entropy", "threshold": 4.0, "charset": "hex"}, {"kind": "field-name", "pattern": "pin$"}, {"kind": "regex", "pattern": "("}]'
    got = rule_files.compile_rules(rule_files.parse(text))
    assert [(r.category, r.kind, r.min_length) for r in got.rules] == [("auth_token", "regex", None), ("custom:site", "literal", 4)]
    assert got.allow == ["localhost", "*.example"] and got.entropy[0].threshold == 4.0 and got.signals[0].key == "pin$" and len(got.errors) == 1
    assert "(" not in got.errors[0]
    toml = '[[rules]]\nkind = "literal"\npattern = "acme"\n'
    assert rule_files.parse(toml, "x.toml")[0]["pattern"] == "acme" == rule_files.parse(toml)[0]["pattern"]
    assert rule_files.parse("") == [] and len(rule_files.merge(got, got).rules) == 2
    with pytest.raises(rule_files.RuleFileError):
        rule_files.compile_rules(rule_files.parse(text), strict=True)


def test_values_found_in_one_input_go_everywhere(spark):
    secret = 'pa"ss<word>9'
    rows = [("conf/app.json", '{"db": {"password": "pa\\"ss<word>9", "host": "h"}}'), ("run.log", f"login {secret} from jo@corp.example"), ("page.xml", "<a>pa\"ss&lt;word>9</a>"), ("e.txt", None), ("e.txt", "")]
    p = [profiles.Profile("json", (".json",), (FieldRule("*.password", "custom:password"),))]
    out = profiles.sanitize(spark.createDataFrame(rows, "path string, text string"), "path", "text", BUILT_IN[:2], p, [EntropyRule()]).collect()
    got = {r.path: r.sanitized for r in out}
    assert len(out) == 5 and not any("ss<word" in t or "ss&lt;word" in t or "jo@" in t for t in got.values())
    assert got["conf/app.json"].endswith('"host": "h"}}') and got["run.log"].split()[1] in got["conf/app.json"] and got["run.log"].endswith("@corp.example") and got["e.txt"] == ""
    assert profiles.discover(spark.createDataFrame(rows, "path string, text string"), "path", "text", []).count() == 0


def test_entropy_rules_in_order(spark):
    hex_ = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"
    df = spark.createDataFrame([(f"a={hex_};b={'a' * 30}, Zq3vX8kLw9TbN5yRm2PcHd7Gs",), (None,), ("",)], "t string")
    rules = [EntropyRule("hex", "auth_token", 16, 64, 3.0, "hex"), EntropyRule("rest", "custom:x")]
    got = redact_tokens(df, "t", rules).collect()
    assert hex_ not in got[0].sanitized and "a" * 30 in got[0].sanitized and got[0].entropy_counts == {"hex": 1, "rest": 1} and got[0].n_entropy == 2
    assert [r.sanitized for r in got[1:]] == ["", ""] and got[1].entropy_counts == {}
    assert redact_tokens(df, "t", []).first().sanitized == df.first().t


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("jo@corp.example\n\n10.1.2.3 x\n")
    lines = scans.read_lines(spark, str(tmp_path / "in"))
    scans.write(scans.redact_stream(lines, "value", BUILT_IN[:2]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    batch = scan.redact(spark.read.text(str(tmp_path / "in")), "value", BUILT_IN[:2]).select("sanitized", F.size("matches").cast("long"))
    assert got == sorted(map(tuple, batch.collect())) and sum(n for _, n in got) == 2
    timed = lines.select("value", F.timestamp_seconds(F.lit(0)).alias("at"))
    q = scans.count_stream(timed, "value", "at", BUILT_IN[:2]).writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.pattern, r.matches) for r in spark.table("found").collect()) == [("email", 1), ("ipv4", 1)]


def test_strategies(spark):
    df = spark.createDataFrame([("a.b",), ("...",), (None,), ("",)], "v string")
    for name in [*strategies.STRATEGIES, "category_aware"]:
        got = [r[0] for r in df.select(strategies.apply(name, F.col("v"), "email", DEMO_KEY)).collect()]
        assert got[2] is None and got[0]
    assert [r[0] for r in df.select(strategies.apply("fake_ip", F.col("v"), "ipv4")).collect()][1] == "..."
    with pytest.raises(ValueError):
        strategies.register("fake_ip", strategies.fake_ip)


def test_aliases_share_a_replacement(spark):
    d = spark.createDataFrame([("c", 'a"b', "S1"), ("c", "plain", "S2"), ("c", 'a\\"b', "S3")], "category string, original string, sanitized string")
    got = {r.original: r.sanitized for r in aliases.with_aliases(d).collect()}
    assert got['a""b'] == "S1" and got['a\\"b'] == "S3" and got["plain"] == "S2" and got["a&quot;b"] == "S1"


def test_patterns_prompts_and_reports(spark):
    df = spark.createDataFrame([("jo@corp.example",), ("x 10.0.0.1",), (None,)], "v string")
    got = sorted(tuple(r) for r in textutil.test_patterns(df, "v", BUILT_IN[:2]).collect())
    assert got == [("jo@corp.example", "email", 0, 15, "jo@corp.example", False), ("x 10.0.0.1", "ipv4", 2, 10, "10.0.0.1", True)]
    logs = spark.createDataFrame([("f", "a\nan error\nb"), ("g", "quiet")], "path string, sanitized string")
    events = textutil.notable_events(textutil.log_context(logs, "path", "sanitized"), "path")
    made = {r.path: r.prompt for r in textutil.prompts(logs, "path", "sanitized", "Look:", events).collect()}
    assert "  a\n>>> [error] an error\n  b" in made["f"] and "notable" not in made["g"] and "<content>\nquiet" in made["g"]
    counts = spark.createDataFrame([("f<", "email", 2), ("f<", "ipv4", 2)], "path string, pattern string, matches long")
    assert "f&lt;" in report.html(counts, "path") and "startLine" not in report.sarif_lines(report.sarif_results(counts, "path")).first().result
    assert report.redaction_line(counts, "path").first().line == "email (2), ipv4 (2)" and report.fail_on_match(counts.limit(0)).first().exit_code == 0
    sizes = spark.createDataFrame([(5,), (1536,), (3 << 30,)], "n long").select(report.byte_format(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["5 B", "1.5 KiB", "3.0 GiB"]


def test_output_names_do_not_clash(spark):
    df = spark.createDataFrame([("a.log",), ("a.log",), ("d/b.tgz",), ("d/noext",)], "path string")
    assert sorted(r.output for r in inputs.output_names(df, "path").collect()) == ["a-sanitized-1.log", "a-sanitized.log", "d/b.sanitized.tar.gz", "d/noext-sanitized"]
