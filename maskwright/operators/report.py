"""Reports over a table of (id, pattern, matches)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels reported as errors; all others are warnings (fixed values).
ERRORS = ("email", "name", "phone", "credit_card", "ssn", "auth_token", "jwt")


def severity(label: Column) -> Column:
    return F.when(label.isin(*ERRORS), "error").otherwise("warning")


def rule_name(label: Column) -> Column:
    """CamelCase of a label on _, : and -."""
    return F.array_join(F.transform(F.split(label, "[_:-]"), lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2)))), "")


def summary(counts: DataFrame) -> DataFrame:
    """pattern, files, matches."""
    return counts.groupBy("pattern").agg(F.count("*").alias("files"), F.sum("matches").alias("matches"))


def sarif_rules(counts: DataFrame) -> DataFrame:
    """id, name and level of every rule that has a result."""
    return counts.select(F.col("pattern").alias("id")).distinct().select("id", rule_name(F.col("id")).alias("name"), severity(F.col("id")).alias("level"))


def ndjson(counts: DataFrame, id_: str) -> DataFrame:
    """One JSON line for each id: its path, its total and its labels in order."""
    labels = F.map_from_entries(F.sort_array(F.collect_list(F.struct("pattern", "matches"))))
    return counts.groupBy(id_).agg(F.to_json(F.struct(F.col(id_).cast("string").alias("path"), F.sum("matches").alias("matches"), labels.alias("patterns"))).alias("line"))


def files(df: DataFrame, id_: str, text: str, counts: DataFrame, method: Column | str = "scanner") -> DataFrame:
    """id, method, bytes, matches and patterns (label to matches) of every row of df, those without findings included.

    method says how a row was read: a column, or one name for all.
    """
    labels = F.map_from_entries(F.sort_array(F.collect_list(F.struct("pattern", "matches"))))
    found = counts.groupBy(id_).agg(F.sum("matches").alias("matches"), labels.alias("patterns"))
    own = df.select(id_, (F.lit(method) if isinstance(method, str) else method).alias("method"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"))
    none = F.create_map().cast("map<string,bigint>")
    return own.join(found, id_, "left").select(id_, "method", "bytes", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("patterns", none).alias("patterns"))


def findings(per_file: DataFrame, id_: str) -> DataFrame:
    """NDJSON lines (kind, file, line) of files(): one for each file and a summary, which has no file."""
    some = F.when(F.size("patterns") > 0, F.col("patterns"))
    one = F.to_json(F.struct(F.lit("file").alias("type"), F.col(id_).cast("string").alias("file"), "matches", (F.col("matches") == 0).alias("clean"), some.alias("patterns"), F.col("bytes").alias("bytes_processed")))
    lines = per_file.select(F.lit("file").alias("kind"), F.col(id_).cast("string").alias("file"), one.alias("line"))
    n, total = F.count("*"), F.coalesce(F.sum("matches"), F.lit(0))
    last = per_file.agg(F.to_json(F.struct(F.lit("summary").alias("type"), n.alias("files"), total.alias("matches"), (total == 0).alias("clean"))).alias("line"))
    return lines.unionByName(last.select(F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("file"), "line"))


def archive_stats(entries: DataFrame, structured: Column | None = None, taken: Column | None = None) -> DataFrame:
    """archive, files, nested, filtered, structured, scanned and bytes of entries() rows.

    structured and taken tell of an entry whether a format reader takes it and
    whether the entry filter lets it pass.
    """
    passed, read = F.lit(True) if taken is None else taken, F.lit(False) if structured is None else structured
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    nested = F.when(F.col("depth") > 1, F.substring_index("entry", "!", 1))
    return entries.groupBy("archive").agg(
        count(passed).alias("files"), F.count_distinct(nested).alias("nested"), count(~passed).alias("filtered"), count(passed & read).alias("structured"), count(passed & ~read).alias("scanned"), F.sum(F.when(passed, F.octet_length("content")).otherwise(0)).cast("long").alias("bytes")
    )


def with_edits(counts: DataFrame, edited: DataFrame, id_: str, label: str = "profile-field") -> DataFrame:
    """counts with a row for the fields that readers replaced in each text (a column n_edits of edited)."""
    own = edited.where("n_edits > 0").select(id_, F.lit(label).alias("pattern"), F.col("n_edits").cast("long").alias("matches"))
    return counts.select(id_, "pattern", "matches").unionByName(own).groupBy(id_, "pattern").agg(F.sum("matches").alias("matches"))


@dataclass(frozen=True)
class Metadata:
    """What a run was made with; a report holds it beside the totals."""

    version: str
    timestamp: str
    deterministic: bool = False
    dry_run: bool = False
    strict: bool = False
    chunk_size: int = 0
    threads: int | None = None
    secrets_file: str | None = None

    def row(self) -> Column:
        return F.struct(*(F.lit(v).cast("string" if v is None else {str: "string", bool: "boolean", int: "bigint"}[type(v)]).alias(k) for k, v in vars(self).items()))


def whole(per_file: DataFrame, id_: str, metadata: Metadata) -> DataFrame:
    """The report's head as JSON (column report): metadata and summary; the files themselves stay the rows of per_file.

    A report of one document with all files in it would be gathered in one
    place; json_report() makes that where it is asked for.
    """
    return _head(per_file, metadata).select(F.to_json(F.struct("metadata", "summary")).alias("report"))


def _head(per_file: DataFrame, metadata: Metadata) -> DataFrame:
    by_label = per_file.select(F.explode("patterns").alias("pattern", "matches")).groupBy("pattern").agg(F.sum("matches").alias("matches"))
    patterns = by_label.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pattern", "matches")))).alias("pattern_counts"))
    total = per_file.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("matches"), F.lit(0)).alias("total_matches"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes_processed"))
    one = F.lit(0).alias("one")  # either side is one row
    return total.select("*", one).join(patterns.select("*", one), "one").select(metadata.row().alias("metadata"), F.struct("total_files", "total_matches", "total_bytes_processed", "pattern_counts").alias("summary"))


def json_report(per_file: DataFrame, id_: str, metadata: Metadata, pretty: bool = False) -> str:
    """One JSON text with metadata, summary and every file, as a small run's report is written."""
    import json

    head = json.loads(whole(per_file, id_, metadata).first()["report"])
    rows = per_file.orderBy(id_).toLocalIterator()
    head["files"] = [{"path": str(r[id_]), "method": r["method"], "matches": r["matches"], "bytes_processed": r["bytes"], "pattern_counts": dict(sorted(r["patterns"].items()))} for r in rows]
    return json.dumps(head, indent=2) if pretty else json.dumps(head, separators=(",", ":"))


def with_context(per_file: DataFrame, context: DataFrame, id_: str) -> DataFrame:
    """files() with log_context: the lines of textutil.log_context() that belong to each file, in order."""
    own = context.groupBy(id_).agg(F.sort_array(F.collect_list(F.struct("line_number", "keyword", "line", "before", "after"))).alias("log_context"), F.max("truncated").alias("log_context_truncated"))
    return per_file.join(own, id_, "left")


def sarif_results(counts: DataFrame, id_: str, locations: DataFrame | None = None) -> DataFrame:
    """One result for each file and label: rule_id, level, message, uri and, where locations know it, start_line."""
    uri = F.replace(F.col(id_).cast("string"), F.lit("\\"), F.lit("/"))
    text = F.concat(F.col("matches").cast("string"), F.lit(" sensitive value(s) of type '"), F.col("pattern"), F.lit("' detected and sanitized."))
    rows = counts.where("matches > 0")
    if locations is None:
        rows = rows.withColumn("start_line", F.lit(None).cast("long"))
    else:
        rows = rows.join(locations.groupBy(id_, "pattern").agg(F.min_by("line", "byte_offset").alias("start_line")), [id_, "pattern"], "left")
    return rows.select(uri.alias("uri"), F.col("pattern").alias("rule_id"), severity(F.col("pattern")).alias("level"), text.alias("message"), "start_line")


def sarif_lines(results: DataFrame) -> DataFrame:
    """Each result as the JSON object of SARIF 2.1.0."""
    where = F.struct(F.col("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine")))
    place = F.array(F.struct(F.struct(where.alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return results.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))).alias("result"))


def byte_format(n: Column) -> Column:
    """Bytes as B, KiB, MiB or GiB, the latter with one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in ((10, "KiB"), (20, "MiB"), (30, "GiB")):
        out = F.when(n >= 1 << k, F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / (1 << k), 1))).otherwise(out)
    return out


def redaction_line(counts: DataFrame, id_: str) -> DataFrame:
    """For each id its labels by count, most first, then by name: ``email (3), ipv4 (1)``."""
    key = lambda c: F.struct((-c["matches"]).alias("n"), c["pattern"].alias("p"))
    pairs = F.sort_array(F.collect_list(key({"matches": F.col("matches"), "pattern": F.col("pattern")})))
    return counts.groupBy(id_).agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["p"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")"))), ", ").alias("line"))


def fail_on_match(counts: DataFrame) -> DataFrame:
    """One row: whether anything was found, and the exit code that says so."""
    hit = F.coalesce(F.max(F.col("matches") > 0), F.lit(False))
    return counts.agg(hit.alias("failed"), F.when(hit, 2).otherwise(0).alias("exit_code"))


def html(counts: DataFrame, id_: str, top: int = 1000) -> str:
    """A self-contained page with the totals of every label and the files with the most findings; top bounds the list, as a report does."""
    from html import escape

    table = lambda head, rows: "<table><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows) + "</table>"
    labels = summary(counts).orderBy(F.desc("matches"), "pattern").collect()
    files = counts.groupBy(id_).agg(F.sum("matches").alias("matches")).orderBy(F.desc("matches"), id_).limit(top).collect()
    style = "<style>body{font-family:sans-serif}td,th{padding:2px 12px;text-align:left}</style>"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Findings</title>{style}</head><body><h1>Findings</h1>{table(('label', 'files', 'matches'), labels)}<h2>Files</h2>{table(('file', 'matches'), files)}</body></html>"
