"""Settings, keys, whole runs, the command line, groups and folds on small inputs."""

import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright import __main__ as cli
from maskwright import config, crypto, engine
from maskwright.functions.arrays import blocks, cut, emit, splice
from maskwright.operators import fields, filters, propagate, scan, store, textutil
from maskwright.operators.fields import FieldRule
from maskwright.plans.extra import detection_cases
from maskwright.rules import BUILT_IN, Rule, cut_at_group
from maskwright.sources import bundles, files, presets, rule_files


def test_argon2id_known_answer():
    got = crypto.argon2id(b"\x01" * 32, b"\x02" * 16, 32, 32, 3, 4, b"\x03" * 8, b"\x04" * 12)
    assert got.hex() == "0d640df58d78766c08c037a34a8b53c9d01ef0452d75b65eb52520e96b01e659"


def test_encrypted_files(spark, tmp_path, monkeypatch):
    cost = {"memory": 32, "passes": 1}
    raw = crypto.encrypt(spark, b"- a: 1", "pw", **cost)
    assert crypto.is_encrypted(raw) and crypto.decrypt(spark, raw, "pw", **cost) == b"- a: 1"
    for bad, password in ((raw, "other"), (raw[:-1] + b"x", "pw"), (b"plain", "pw"), (raw[:5] + b"\x02" + raw[6:], "pw")):
        with pytest.raises(crypto.CryptoError):
            crypto.decrypt(spark, bad, password, **cost)
    secret = tmp_path / "pw"
    secret.write_text("hidden\n")
    os.chmod(secret, 0o644)
    with pytest.raises(crypto.CryptoError):
        crypto.find_password(path=str(secret))
    os.chmod(secret, 0o600)
    assert crypto.find_password(path=str(secret)) == "hidden" and crypto.find_password("given") == "given"
    monkeypatch.setenv("MASKWRIGHT_SALT", "0aff")
    assert crypto.find_salt() == b"\x0a\xff"
    monkeypatch.delenv("MASKWRIGHT_SALT")
    own = str(tmp_path / "salt")
    assert crypto.find_salt(own=own) == crypto.find_salt(own=own) and len(crypto.find_salt(own=own)) == 32


def test_groups_are_cut_out_of_patterns():
    assert cut_at_group(r"(?i)a[(\]](b(?:c|d))e") == ("(?i)", r"a[(\]]", "b(?:c|d)", "e")
    assert cut_at_group("x|(a)") is None and cut_at_group("(?:(a)|b)") is None and cut_at_group("(a)?b") is None and cut_at_group("[]()](a)") == ("", "[]()]", "a", "")
    assert all(r.parts for r in BUILT_IN if r.has_group)


def test_group_places(spark):
    df = spark.createDataFrame([("password=password",), ("/home/home/x",), ("pwd=pwd=pwdpwd",)], "t string")
    got = [r[0] for r in scan.redact(df, "t", BUILT_IN).select("sanitized").collect()]
    assert got[0].startswith("password=") and not got[0].endswith("password") and got[1].startswith("/home/") and got[1].endswith("/x") and "home/home" not in got[1]
    assert len(got[2]) == len("pwd=pwd=pwdpwd") and "pwdpwd" not in got[2]


def test_every_hint_holds_for_every_hit(spark):
    rows = [(text.replace("{}", secret),) for _, text, secret in detection_cases()]
    df = spark.createDataFrame(rows, "t string").cache()
    bare = [Rule(r.pattern, r.category, r.label) for r in BUILT_IN]
    with_, without = (sorted(map(tuple, scan.counts(df, "t", "t", rules).collect())) for rules in (BUILT_IN, bare))
    assert with_ == without and {p for _, p, _ in with_} >= {"jwt", "slack_token", "openai_api_key"}


def test_fast_patterns_have_the_same_matches(spark):
    texts = ["a@b.co_x@c.de", "a@b.comc@d.org", "x" * 300 + "@", "..a+b%c@h.example,z@y.zz", "9abc://u:p@h x.y1z+://a:b@c/d", "abc://u:p@h", "a.b.c://x:y@z://k:l@m", "A@B.CDé@f.gh", "s3://k:v@w", "http://a:b@c@d.example"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in BUILT_IN:
        if r.fast:
            got, want = (sorted(df.select("t", scan.find_matches(F.col("t"), [x]).alias("m")).select("t", F.transform("m", lambda m: F.struct(m["start"], m["stop"], m["value"])).alias("m")).collect()) for x in (r, Rule(r.pattern, r.category, r.label)))
            assert got == want and any(row.m for row in got)


def test_long_texts_and_many_matches(spark):
    text = "é " * 30_000 + "a@b.example\n" * 3_000 + "x" * 50_000
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    got = {r.id: r for r in scan.redact(df, "t", BUILT_IN).collect()}
    assert len(got[1].matches) == 3_000 and len(got[1].sanitized) == len(text) and "a@b" not in got[1].sanitized and got[2].sanitized == got[3].sanitized == ""
    where = scan.locations(df, "id", "t", BUILT_IN).orderBy("byte_offset").collect()
    assert [(r.line, r.byte_offset) for r in where[:2]] == [(1, 90_000), (2, 90_012)] and len(where) == 3_000
    capped = scan.locations(df, "id", "t", BUILT_IN, cap=2).collect()
    assert len(capped) == 2 and all(r.truncated for r in capped)


def test_folds_and_cuts(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("xs"), F.lit("aé" * 3000).alias("t"))
    sums = emit(F.col("xs"), F.lit(0).cast("bigint"), "bigint", lambda s, x: (s + x, F.array(s + x)))
    row = df.select(sums.alias("s"), cut(blocks(F.col("t")), F.lit(2040), F.lit(4100)).alias("c"), cut(blocks(F.col("t")), F.lit(5), F.lit(5)).alias("n"), emit(F.slice("xs", 1, 0), F.lit(0), "int", lambda s, x: (s, F.array(s))).alias("e")).first()
    assert row.s[-1] == 500500 and row.s[127:130] == [8256, 8385, 8515] and row.c == ("aé" * 3000)[2040:4100] and row.n == "" and row.e == []
    edits = F.array(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")), F.struct(F.lit(4000).alias("a"), F.lit(4000).alias("b")))
    assert df.select(splice(F.col("t"), edits, "a", "b", lambda e: F.lit("#"))).first()[0] == "a#" + ("aé" * 3000)[2:4000] + "#" + ("aé" * 3000)[4000:]


def test_settings(tmp_path):
    layer = config.rooted(config.parse("include: ['*.log']\nstrict: true\ndepth: 3\nrules: r.yaml\n", "s.yaml"), "/base")
    got = config.merged(config.arguments(["a.log", "--include", "*.txt", "--depth", "7"]), {"depth": 2, "include": ["*.md"]}, layer)
    assert got.include == ("*.md", "*.log", "*.txt") and got.strict and got.depth == 7 and got.rules == "/base/r.yaml"
    assert config.merged(config.Settings(), {"depth": 2}, layer).depth == 3
    filters = config.arguments(["a.zip", "--only", "x/,y", "--exclude=z", "b.log", "--exclude", "*.gz"])
    assert filters.filters == {"a.zip": (("x/", "y"), ("z",))} and filters.exclude == ("*.gz",)
    for bad in (["--only", "x"], ["--nope"], ["--depth", "x"], ["--rules"], ["a.zip", "--only"]):
        with pytest.raises(config.ConfigError):
            config.arguments(bad)
    for bad in ({"depth": 11}, {"format": "doc"}, {"preset": "x"}, {"inputs": ("-", "-")}, {"inputs": ("missing",)}, {"dry_run": True, "output": "o"}, {"filters": {"a.log": ((), ())}}):
        with pytest.raises(config.ConfigError):
            config.Settings(**bad).check(exists=lambda p: False)
    with pytest.raises(ValueError):
        bundles.resolve(["no such"])
    with pytest.raises(config.ConfigError):
        config.parse("colour: red", "s.yaml")
    assert bundles.resolve(["redis"], {"redis": ()}) == [] and len(bundles.BUNDLES) == 28


def test_whole_run(spark, tmp_path, capsys):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / "redis.conf").write_text("requirepass hunter2hunter2\n")
    (tmp_path / "in" / "app.log").write_text("ERROR for jo@corp.example with hunter2hunter2\n")
    (tmp_path / "in" / "blob.bin").write_bytes(b"\x00\x01jo@corp.example")
    (tmp_path / "in" / ".git" / "config").write_text("jo@corp.example")
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w") as z:
        z.writestr("one.txt", "mail jo@corp.example")
        z.writestr("two.md", "mail jo@corp.example")
    settings = config.Settings(inputs=(str(tmp_path / "in"),), apps=("redis",), preset="web", filters={"a.zip": (("*.txt",), ())})
    done = engine.run(spark, settings, key=bytes(32))
    out = {r.path.rsplit("/", 1)[-1]: (r.output.rsplit("/", 1)[-1], bytes(r.content)) for r in done.outputs.collect()}
    assert set(out) == {"redis.conf", "app.log", "blob.bin", "a.zip"} and out["blob.bin"][1] == b"\x00\x01jo@corp.example" and out["a.zip"][0] == "a.sanitized.zip"
    assert b"hunter2" not in out["redis.conf"][1] + out["app.log"][1] and b"jo@" not in out["app.log"][1]
    inner = zipfile.ZipFile(io.BytesIO(out["a.zip"][1]))
    assert b"jo@" not in inner.read("one.txt") and inner.read("two.md") == b"mail jo@corp.example"
    assert done.exit_code(True) == 2 and done.exit_code(False) == 0
    methods = {r.path.rsplit("/", 1)[-1]: r.method for r in done.per_file.collect()}
    assert methods["redis.conf"] == "structured:key_value" and methods["app.log"] == "scanner"
    assert json.loads(engine.report.json_report(done.per_file, "path", done.metadata))["summary"]["total_files"] == 3


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["apps"]) == 0 and "gitlab" in capsys.readouterr().out
    assert cli.main(["template", "aws"]) == 0 and "aws_arn" in capsys.readouterr().out
    assert cli.main(["allow-test", "localhost", "other"]) == 1
    (tmp_path / "app.log").write_text("ERROR for jo@corp.example\n")
    (tmp_path / "r.yaml").write_text("- {kind: regex, pattern: 'jo@[a-z.]+', category: email, label: mail}\n")
    assert cli.main(["sanitize", str(tmp_path / "app.log"), "--rules", str(tmp_path / "r.yaml"), "--output", str(tmp_path), "--fail-on-match"]) == 2
    assert b"jo@" not in (tmp_path / "app-sanitized.log").read_bytes() and "mail (1)" in capsys.readouterr().err


def test_no_value_in_messages(spark):
    canary = "cAnArY-4711"
    for call in (lambda: rule_files.compile_rules([{"kind": "regex", "pattern": f"({canary}"}], strict=True), lambda: rule_files.parse(f'["{canary}"', "x.json"), lambda: rule_files.parse(f"= {canary}", "x.toml")):
        with pytest.raises(rule_files.RuleFileError) as bad:
            call()
        assert canary not in str(bad.value)
    assert canary not in str(rule_files.compile_rules([{"kind": "regex", "pattern": f"({canary}"}]).errors) and canary not in str(textutil.checked_patterns([f"regex:({canary}"])[1])


def test_store_capacity_and_phases(spark):
    first = store.build(spark.createDataFrame([("email", "a@b.c"), ("email", "a@b.c"), ("x", "***")], "category string, original string"))
    more = spark.createDataFrame([("email", "a@b.c"), ("email", "d@e.f")], "category string, original string")
    assert store.extend(first, more.limit(0), capacity=1).count() == 1
    with pytest.raises(store.CapacityError):
        store.extend(first, more, capacity=1)
    assert [(r.original, r.phase) for r in store.since(store.extend(first, more), 0).collect()] == [("d@e.f", 1)]
    assert store.build(more.limit(0)).count() == 0


def test_sub_processors_are_known():
    with pytest.raises(ValueError):
        FieldRule("a", "email", sub_processor="xml")
    assert len(fields.flat([FieldRule("a", "email", sub_processor="json", sub_rules=(FieldRule("b", "name"),))])) == 2


def test_presets_are_rule_files():
    for name in presets.PRESETS:
        got = rule_files.compile_rules(rule_files.parse(presets.template(name), "p.yaml"), strict=True)
        assert [r.label for r in got.rules] == [e["label"] for e in presets.entries(name) if e["kind"] == "regex"]
    with pytest.raises(ValueError):
        presets.entries("none")


def test_whole_writes(spark, tmp_path):
    files.write_whole(spark, str(tmp_path / "r.json"), b"1")
    files.write_whole(spark, str(tmp_path / "r.json"), b"22")
    assert (tmp_path / "r.json").read_bytes() == b"22" and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["r.json"]


def test_large_dictionaries_are_looked_for_too(spark, monkeypatch):
    values = [("email", f"user{k}@corp.example") for k in range(40)] + [("auth_token", v) for v in ("abcd", "abcdefg", "efgh", "über-ключ-😀", "user1@corp.example.org", "😀")] + [("email", "abcd"), ("email", "abc")]
    texts = ["", None, "user1@corp.example.org user1@corp.example user10@corp.example", "xabcdefghabcdefgh", "abcd" * 50, "das über-ключ-😀! abc 😀", "none", "abcd" * 50, "abcdef", "user3@corp.exampl"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    dictionary = spark.createDataFrame(values, "category string, original string")
    want = sorted(map(str, propagate.redact_known(df, "t", dictionary).collect()))
    monkeypatch.setattr(propagate, "AUTOMATON_BYTES", 0)
    got = propagate.redact_known(df, "t", dictionary)
    assert got.columns == ["id", "t", "found", "sanitized"] and sorted(map(str, got.collect())) == want
    odd = spark.createDataFrame([(0, 'a "q" & b and a &quot;q&quot; &amp; b or a \\"q\\" & b')], "id int, t string")
    quoted = spark.createDataFrame([("auth_token", 'a "q" & b')], "category string, original string")
    assert propagate.redact_known(odd, "t", quoted, escaped=True).first()["found"].__len__() == 3


def test_places_over_sections(monkeypatch):
    values = ["abcd", "abcdefghi", "hij", "z" * 40]
    h = [filters._Hashes(v) for v in values]
    words = np.zeros(1 << 10, np.uint64)
    for v, x in zip(values, h, strict=True):
        for n in (filters._classes(np.array([len(v)]))[0], len(v)):
            bit = int(x.spans(np.array([0]), int(n))[0]) & 0xFFFF
            words[bit >> 6] |= np.uint64(1 << (bit & 63))
    table = filters.Table(words, tuple(sorted(map(len, values))))
    texts = [None, "", "xabcdefghijk" + "z" * 43, "abc", "abcd"]
    want = {(r, v, k) for r, t in enumerate(texts) for v in values for k in range(len(t or "")) if t.startswith(v, k)}
    for block in (1, 3, 16, 1 << 20):
        monkeypatch.setattr(filters, "BLOCK", block)
        got = [(r, f, k) for rows, fs, starts in filters.search(texts, table) for r, f, ks in zip(rows, fs, starts, strict=True) for k in ks]
        assert len(got) == len(set(got)) and {x for x in got if x[1] in values} == want
