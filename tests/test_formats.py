from maskwright.operators import fields, propagate
from maskwright.operators.fields import FieldRule
from maskwright.sources import formats

RULES = [FieldRule("*.secret", "auth_token", min_length=4)]


def test_readers_take_empty_null_and_malformed_texts():
    for fmt in formats.READERS:
        assert formats.spans(None, fmt) is None
        assert formats.spans("", fmt) in ([], None)
    for fmt, text in (("json", '{"a": [1}'), ("xml", "<a><b></a>"), ("toml", "= 1"), ("yaml", "a: [1")):
        assert formats.spans(text, fmt) is None


def test_spans_stand_for_their_values():
    text = '{"é": "ü", "n": -1.5e3, "l": [null, {"k": "v"}]}'
    assert [(p, text[a:b]) for p, a, b, _, _ in formats.spans(text, "json")] == [("é", "ü"), ("n", "-1.5e3"), ("l", "null"), ("l.k", "v")]


def test_rules_nulls_and_repeats(spark):
    rows = [(1, '{"db": {"secret": "abcd"}}'), (1, '{"db": {"secret": "abcd"}}'), (2, None), (3, ""), (4, "no json"), (5, '{"secret": "abc"}')]
    df = spark.createDataFrame(rows, "id int, t string")
    got = [(r["id"], r["sanitized"]) for r in fields.redact_fields(df, "t", "json", RULES).collect()]
    assert got[0] == got[1] and "abcd" not in got[0][1]
    assert got[2:] == [(2, ""), (3, ""), (4, "no json"), (5, '{"secret": "abc"}')]


def test_path_globs():
    import re

    def fits(glob, path):
        return re.search(fields.path_regex(glob).replace(r"\z", r"\Z"), path) is not None

    assert fits("*.password", "db.password") and fits("*.password", "password") and not fits("*.password", "dbpassword")
    assert fits("db.*", "db.a.b") and not fits("db.*", "db") and fits("*pass*", "a.passwd") and not fits("db", "db.x")


def test_empty_dictionary_leaves_texts(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    none = spark.createDataFrame([], "category string, original string")
    assert [r["sanitized"] for r in propagate.redact_known(df, "t", none).collect()] == ["a", ""]
