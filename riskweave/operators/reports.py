"""Findings as reports, quality counters and their statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import dialect
from riskweave.operators.audit import quality_status


def rank(severity: Column) -> Column:
    """critical 0 .. low 3, others 4."""
    return F.coalesce(3 - dialect.severity_score(severity), F.lit(4))


def by_file(findings: DataFrame) -> DataFrame:
    """(file, n_findings, max_severity)."""
    g = findings.groupBy(F.coalesce(F.nullif("matched_file", F.lit("")), F.lit("unknown")).alias("file")).agg(F.count("*").alias("n_findings"), F.min(rank(F.col("severity"))).alias("r"))
    return g.select("file", "n_findings", F.element_at(F.array(*map(F.lit, [*dialect.SEVERITIES, "unknown"])), F.col("r") + 1).alias("max_severity"))


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n_findings"), F.count_distinct("matched_file").alias("n_files"))


def by_severity(findings: DataFrame) -> DataFrame:
    """One row a severity; none are left out."""
    names = findings.sparkSession.createDataFrame([(x,) for x in [*dialect.SEVERITIES, "unknown"]], "severity string")
    counts = findings.groupBy("severity").count()
    return names.join(counts, "severity", "left").select("severity", F.coalesce("count", F.lit(0)).alias("n"))


def markdown(findings: DataFrame, title: str = "# Change risk report") -> DataFrame:
    """(diff_id, report): findings by file, files in order, items by severity and load order."""
    item = F.concat(F.lit("- **"), F.upper("severity"), F.lit("** `"), "rule_id", F.lit("`"))
    files = findings.groupBy("diff_id", "matched_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank(F.col("severity")).alias("r"), "load_order", item.alias("t")))), lambda x: x.t), "\n").alias("items"), F.count("*").alias("n"))
    part = F.concat(F.lit("## "), "matched_file", F.lit("\n"), "items")
    whole = files.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("matched_file", part.alias("t")))), lambda x: x.t), "\n\n").alias("body"), F.sum("n").alias("n"))
    return whole.select("diff_id", F.concat(F.lit(title + "\n\n"), "body", F.lit("\n\n---\n"), F.col("n").cast("string"), F.lit(" findings")).alias("report"))


def html_rows(findings: DataFrame) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td>"), dialect.html_escape(F.col(c)), F.lit("</td>"))
    return findings.select("diff_id", "load_order", F.concat(F.lit("<tr>"), cell("rule_id"), cell("severity"), cell("matched_file"), F.lit("</tr>")).alias("html"))


def as_json(findings: DataFrame) -> DataFrame:
    return findings.select("diff_id", "load_order", F.to_json(F.struct("rule_id", "severity", F.col("matched_file").alias("file"), "is_blocking")).alias("json"))


def inline_comments(findings: DataFrame, positions: DataFrame) -> DataFrame:
    """findings with the place of their comment, of parse.patch_positions: the first added line of the last patch of their file in their diff, else that of the
    diff's first patch; a diff without patches keeps the finding's file at place 1."""
    place = F.struct("file", "position", "line")
    own = positions.groupBy("diff_id", F.col("file").alias("matched_file")).agg(F.max_by(place, "grp").alias("own"))
    first = positions.groupBy("diff_id").agg(F.min_by(place, "grp").alias("first"))
    both = findings.join(own, ["diff_id", "matched_file"], "left").join(first, "diff_id", "left")
    at = F.coalesce("own", "first", F.struct(F.col("matched_file").alias("file"), F.lit(1).alias("position"), F.lit(1).alias("line")))
    body = F.concat(F.lit("**"), F.upper("severity"), F.lit("** "), "rule_id")
    return both.withColumn("at", at).select("diff_id", "load_order", "rule_id", F.col("at.file").alias("path"), "at.position", "at.line", body.alias("body"))


def upsert(old: DataFrame, new: DataFrame, key: str = "tag") -> DataFrame:
    """Rows of new replace those of old with the same key."""
    n = new.select(key, F.col("body").alias("new_body"))
    return old.join(n, key, "full").select(key, F.coalesce("new_body", "body").alias("body"), F.when(F.col("new_body").isNull(), "kept").when(F.col("body").isNull(), "created").otherwise("updated").alias("change"))


def counters(runs: DataFrame) -> DataFrame:
    """(rule_id, calls, hits, ignores, time_ns) of runs(rule_id, hit, ignored, time_ns)."""
    return runs.groupBy("rule_id").agg(F.count("*").alias("calls"), F.count_if("hit").alias("hits"), F.count_if("ignored").alias("ignores"), F.sum("time_ns").alias("time_ns"))


def quality(counted: DataFrame) -> DataFrame:
    """(rule_id, hits, confirmed, false_positive, precision): a hit is confirmed unless it was ignored."""
    return counted.select("rule_id", "hits", (F.col("hits") - F.col("ignores")).alias("confirmed"), F.col("ignores").alias("false_positive"), F.when(F.col("hits") == 0, 1.0).otherwise(F.round((F.col("hits") - F.col("ignores")) / F.nullif(F.col("hits"), F.lit(0)), 4)).alias("precision"))


def accumulate(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Counters added to stored ones."""
    return stored.select("rule_id", "calls", "hits", "ignores", "time_ns").unionByName(new.select("rule_id", "calls", "hits", "ignores", "time_ns")).groupBy("rule_id").agg(*[F.sum(c).alias(c) for c in ("calls", "hits", "ignores", "time_ns")])


def warnings(q: DataFrame, **limits) -> DataFrame:
    return q.withColumn("status", quality_status(F.col("hits"), F.col("precision"), **limits)).where("status in ('degraded', 'disabled')").select("rule_id", "status", "precision")
