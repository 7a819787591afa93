"""A whole run from settings: rules, inputs, archives, replacement, outputs and reports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Settings
from .functions.lengths import drawn_for
from .functions.replace import DEMO_KEY
from .operators import inputs, profiles, report, scan, textutil
from .rules import BUILT_IN, BUILT_IN_ALLOWED
from .sources import archives, bundles, files, presets, rule_files


@dataclass
class Run:
    """What a run has made: outputs (path, output, content), the files' report and the counts behind it."""

    outputs: DataFrame
    per_file: DataFrame
    counts: DataFrame
    locations: DataFrame
    metadata: report.Metadata

    def exit_code(self, fail_on_match: bool) -> int:
        return 2 if fail_on_match and not self.counts.isEmpty() else 0


def rule_set(spark: SparkSession, settings: Settings) -> rule_files.RuleSet:
    """Rules in the order of their precedence: the rule file, overlays, those of the call, a preset or else the built-in ones."""

    def load(path: str) -> rule_files.RuleSet:
        text = spark.read.format("binaryFile").load(path).first()["content"]
        return rule_files.compile_rules(rule_files.parse(bytes(text).decode(), path), settings.strict)

    layers = [load(p) for p in ([settings.rules] if settings.rules else []) + list(settings.overlay)]
    if settings.quick:
        layers.append(rule_files.quick_rules(list(settings.quick)))
    if settings.preset:
        layers.append(rule_files.compile_rules(presets.entries(settings.preset), strict=True))
    own = bool(settings.rules or settings.preset)
    if not own:
        layers.append(rule_files.RuleSet(rules=list(BUILT_IN)))
    out = rule_files.merge(*layers)
    out.allow += [p for p in settings.allow if p not in out.allow]
    if (not own or settings.apps) and not settings.no_baseline:
        out.allow += [p for p in BUILT_IN_ALLOWED if p not in out.allow]
    return out


def _texts(spark: SparkSession, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Plain inputs and archive entries, each as archive, path, text, binary and content."""
    roots = [i for i in settings.inputs if i != "-"]
    every = files.read(spark, roots, settings.include, settings.exclude, settings.hidden)
    if "-" in settings.inputs:
        every = every.unionByName(files.from_stream(spark, fmt=settings.format))
    kind = inputs.format_of(F.col("path"))
    packed = kind.isin(*inputs.ARCHIVES.values())
    inner = archives.entries(every.where(packed), depth=settings.depth)
    inner = inner.withColumn("taken", files.entry_passes(F.col("archive"), F.col("safe_entry"), settings.filters))
    return files.texts(every.where(~packed)), files.texts(inner.withColumn("path", F.concat("archive", F.lit("!"), "safe_entry")))


def run(spark: SparkSession, settings: Settings, key: bytes = DEMO_KEY) -> Run:
    """The run; nothing is computed until its tables are used.

    Binary files and entries that a filter leaves out pass as they are. Without
    ``deterministic`` the caller passes a key drawn for the run.
    """
    settings.check()
    rules = rule_set(spark, settings)
    allowed = (lambda v: textutil.is_allowed(v, rules.allow)) if rules.allow else None
    apps = bundles.resolve(settings.apps)
    if rules.signals:
        apps = [profiles.Profile(p.format, p.extensions, p.rules, (*p.signals, *rules.signals), p.include, p.exclude, p.options) for p in apps]
    plain, entries = _texts(spark, settings)
    both = plain.where("not binary").select("path", "text").unionByName(entries.where("taken and not binary").select("path", "text"))
    made = drawn_for([r.category for r in rules.rules], key) if settings.drawn_lengths and rules.rules else None
    # both of the outputs' parts read it
    done = profiles.sanitize(both, "path", "text", rules.rules, apps, rules.entropy, key, allowed, made).persist()
    counts = scan.counts(both, "path", "text", rules.rules)
    method = reduce(lambda c, p: F.when(p.takes(F.col("path")), F.lit(f"structured:{p.format}")).otherwise(c), reversed(apps), F.lit("scanner"))
    per_file = report.files(both, "path", "text", counts, method)
    where = scan.locations(both, "path", "text", rules.rules, settings.max_locations)
    put = lambda df: df.join(done, "path", "left").withColumn("content", F.when(F.col("sanitized").isNotNull(), F.encode("sanitized", "UTF-8")).otherwise(F.col("content")))
    named = put(plain).select("path", "content")
    rebuilt = archives.rebuild(put(entries)).select(F.col("archive").alias("path"), "content")
    outputs = inputs.output_names(named.unionByName(rebuilt), "path")
    stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    metadata = report.Metadata(__version__, stamp, settings.deterministic, settings.dry_run, settings.strict, secrets_file=settings.rules)
    return Run(outputs, per_file, counts, where, metadata)


def values(spark: SparkSession, given: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in given], "value string")


def allow_test(spark: SparkSession, given: list[str], patterns: tuple[str, ...] = BUILT_IN_ALLOWED) -> DataFrame:
    """value and the pattern that allows it."""
    return values(spark, given).withColumn("matched", textutil.allowed(F.col("value"), patterns))


def _strip(spark: SparkSession, text: str, delimiter: str = "=", comment: str = "#") -> str:
    return values(spark, [text]).select(textutil.strip_values(F.col("value"), delimiter, comment)).first()[0]


def _sanitized(spark: SparkSession, text: str, rules=BUILT_IN, key: bytes = DEMO_KEY) -> str:
    stays: Column = lambda v: textutil.is_allowed(v, BUILT_IN_ALLOWED)
    return scan.redact(values(spark, [text]), "value", rules, key, stays).first()["sanitized"]


#: The functions that a tool server would offer, by name.
TOOLS = {
    "sanitize": _sanitized,
    "scan": lambda spark, text: scan.counts(values(spark, [text]), "value", "value", BUILT_IN).select("pattern", "matches"),
    "strip_config_values": _strip,
    "test_allowlist": allow_test,
    "list_apps": lambda spark: sorted(bundles.BUNDLES),
    "init": lambda spark, preset="balanced": presets.template(preset),
    "test_pattern": lambda spark, given, entries: textutil.test_patterns(values(spark, given), "value", rule_files.compile_rules(entries, strict=True).rules),
    "build_secrets": lambda spark, entries: rule_files.compile_rules(entries),
    "list_processors": lambda spark: sorted(inputs.EXTENSIONS.values()),
    "list_templates": lambda spark: list(presets.PRESETS),
}
