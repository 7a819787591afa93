"""python -m maskwright COMMAND ARGUMENTS: sanitize, scan, apps, template, allow-test, test-pattern, show-config, encrypt, decrypt."""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config, crypto, engine
from .operators import report, textutil
from .sources import bundles, files, presets, rule_files


def _key(settings: config.Settings) -> bytes:
    """A drawn key, or for deterministic runs the one of the password and the salt."""
    if not settings.deterministic:
        return os.urandom(32)
    return crypto.key_from_password(crypto.find_password(), crypto.find_salt(own=os.path.expanduser("~/.maskwright-salt")))


def settings_of(argv: list[str]) -> config.Settings:
    """The call's settings over those of the project's and the user's files, where there are such."""
    layers = []
    for path in (os.path.expanduser("~/.maskwright.yaml"), ".maskwright.yaml"):
        if os.path.exists(path):
            with open(path) as f:
                layers.append(config.rooted(config.parse(f.read(), path), os.path.dirname(os.path.abspath(path))))
    return config.merged(config.arguments(argv), *layers)


def _sanitize(spark: SparkSession, settings: config.Settings) -> int:
    done = engine.run(spark, settings, _key(settings))
    if not settings.dry_run:
        folder = settings.output
        for row in done.outputs.toLocalIterator():  # one file at a time; tables are written by engine.run's caller
            target = f"{folder.rstrip('/')}/{row['output'].rsplit('/', 1)[-1]}" if folder else row["output"]
            files.write_whole(spark, target, bytes(row["content"]))
    if settings.report:
        files.write_whole(spark, settings.report, report.json_report(done.per_file, "path", done.metadata, pretty=True).encode())
    if settings.findings:
        report.findings(done.per_file, "path").select("line").write.mode("overwrite").text(settings.findings)
    for row in report.redaction_line(done.counts, "path").orderBy("path").toLocalIterator():
        print(f"{row['path']}: {row['line']}", file=sys.stderr)
    return done.exit_code(settings.fail_on_match)


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__)
        return 1
    command, *rest = argv
    if command == "apps":
        print("\n".join(sorted(bundles.BUNDLES)))
        return 0
    if command == "template":
        print(presets.template(rest[0] if rest else "balanced"), end="")
        return 0
    if command == "show-config":
        print(json.dumps(vars(settings_of(rest)), indent=2, default=list))
        return 0
    spark = SparkSession.builder.appName("maskwright").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if command in ("sanitize", "scan"):
        settings = settings_of(rest)
        return _sanitize(spark, config.replace(settings, dry_run=True, output=None, fail_on_match=True) if command == "scan" else settings)
    if command == "allow-test":
        rows = engine.allow_test(spark, rest).collect()
        print("\n".join(f"{r['value']}\t{r['matched'] or '-'}" for r in rows))
        return int(any(r["matched"] is None for r in rows))
    if command == "test-pattern":
        with open(rest[0]) as f:
            rules = rule_files.compile_rules(rule_files.parse(f.read(), rest[0]), strict=True).rules
        for r in textutil.test_patterns(engine.values(spark, rest[1:]), "value", rules).orderBy("value", "label").collect():
            print(f"{r['value']}\t{r['label']}\t{r['start']}-{r['stop']}" + ("\tpartial" if r["partial"] else ""))
        return 0
    if command in ("encrypt", "decrypt"):
        raw = bytes(spark.read.format("binaryFile").load(rest[0]).select(F.col("content")).first()[0])
        files.write_whole(spark, rest[1], getattr(crypto, command)(spark, raw, crypto.find_password()))
        return 0
    print(__doc__)
    return 1


if __name__ == "__main__":
    try:
        sys.exit(main(sys.argv[1:]))
    except (config.ConfigError, crypto.CryptoError, rule_files.RuleFileError) as bad:
        print(f"error: {bad}", file=sys.stderr)
        sys.exit(1)
