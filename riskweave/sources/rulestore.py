"""Rules by language and tier: a table in folders and trees of YAML files, of which only what a run needs is read."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.sources import catalog

TIERS = ["tier1", "tier2", "tier3", "tier4"]
# Folders of tiers, and the tiers of a profile; any other profile has all.
TIER_FOLDERS = {"tier1": "tier1_critical", "tier2": "tier2_high", "tier3": "tier3_medium", "tier4": "tier4_low"}
PROFILE_TIERS = {"lightweight": ["tier1"], "standard": ["tier1", "tier2"]}
# Where tiers lie, and folders at the top of an untiered tree whose bulk isn't loaded.
TIERED = "cve/java/"
SKIPPED = ["java", "go", "python"]
#: Files that one language and tier is written in, so that a hot one isn't a single task's.
PARTS = 8


def tiers_of(profile: str | None) -> list[str]:
    return PROFILE_TIERS.get(profile or "strict", TIERS)


def write(rules: DataFrame, path: str) -> None:
    """rules(rule_id, language, tier, ...) as Parquet in folders language=/tier=; a blank language counts as any (*), a null tier as tier4."""
    language = F.coalesce(F.nullif(F.lower(F.trim("language")), F.lit("")), F.lit("*"))
    named = rules.withColumns({"language": language, "tier": F.coalesce("tier", F.lit("tier4"))})
    named.repartition("language", "tier", F.pmod(F.xxhash64("rule_id"), F.lit(PARTS))).write.partitionBy("language", "tier").parquet(path)


def read(spark: SparkSession, path: str, profile: str | None = None) -> DataFrame:
    """The stored rules of a profile; the folders of other tiers aren't read."""
    stored = spark.read.parquet(path)
    return stored if tiers_of(profile) == TIERS else stored.where(F.col("tier").isin(tiers_of(profile)))


def languages_of(summaries: DataFrame) -> DataFrame:
    """(language): that summaries(files) have by their files' extensions, and any (*)."""
    by_ext = [(x, lang) for lang, exts in catalog.LANGUAGE_EXTENSIONS.items() for x in exts]
    # .h is of two languages
    known = F.create_map(*[F.lit(v) for x in {x for x, _ in by_ext} for v in (x, ",".join(lang for y, lang in by_ext if y == x))])
    ext = summaries.select(F.explode("files").alias("file")).select(F.concat(F.lit("."), F.lower(F.substring_index("file", ".", -1))).alias("ext")).distinct()
    found = ext.select(F.explode(F.split(F.coalesce(known[F.col("ext")], F.lit("")), ",")).alias("language"))
    # one row even without files, of the few languages there are; the scan is pruned by comparisons, not by inequalities or unions
    few = found.agg(F.collect_set("language").alias("some"))
    return few.select(F.explode(F.array_union("some", F.array(F.lit("*")))).alias("language")).where("language > ''")


def for_diffs(stored: DataFrame, summaries: DataFrame) -> DataFrame:
    """Stored rules whose language the diffs have. The languages, a handful, are known when the scan starts, so other folders aren't read."""
    return stored.join(F.broadcast(languages_of(summaries)), "language", "left_semi")


def _below(path: str) -> Column:
    """A file's path below the folder."""
    root = quote(path.rstrip("/").split("://")[-1].removeprefix("file:")) + "/"
    at = F.locate(root, F.col("_metadata.file_path"))
    return F.substr(F.col("_metadata.file_path"), at + len(root))


def bodies(spark: SparkSession, path: str, profile: str | None = None) -> DataFrame:
    """(path, body): the YAML files of a tree that a profile loads.

    A tree with cve/java gives that folder's own files (but those called tier...) and its tiers of the profile; any other tree all but the
    top folders of single rules. The condition is on paths, so files that it excludes are listed, not read."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.yaml")
    below = _below(path)
    if rows.where(below.startswith(TIERED)).isEmpty():
        wanted = ~F.coalesce(F.substring_index(below, "/", 1).isin(SKIPPED) & below.contains("/"), F.lit(False))
    else:
        name = F.substr(below, F.lit(len(TIERED) + 1))
        own = ~name.contains("/") & ~name.startswith("tier")
        wanted = below.startswith(TIERED) & (own | F.substring_index(name, "/", 1).isin([TIER_FOLDERS[t] for t in tiers_of(profile)]) & name.contains("/"))
    return rows.where(wanted).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def repaired(body: Column) -> Column:
    """A quoted description that holds quotes itself, quoted anew by apostrophes."""
    line = r'(?m)^([ \t]*description:[ \t]*)"(.+)"[ \t]*$'
    return F.array_join(F.transform(F.split(body, "\n"), lambda x: F.when(x.rlike(line), F.concat(F.regexp_extract(x, line, 1), F.lit("'"), F.replace(F.regexp_extract(x, line, 2), F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(x)), "\n")


_READ = "path string, pos int, error string, " + catalog.SCHEMA


def _rules_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml  # optional

    names = [c.split()[0] for c in _READ.split(", ")]
    nothing = [None] * (len(names) - 3)
    for batch in batches:
        out = []
        for path, body, mended in batch[["path", "body", "mended"]].itertuples(index=False):
            data, error = None, None
            for text in (body, mended):
                try:
                    data, error = yaml.safe_load(text or ""), None
                    break
                except yaml.YAMLError as e:
                    error = str(e).split("\n")[0]
            if error is None and data is not None and not isinstance(data, dict):
                error = "no mapping"
            try:
                found = [] if error or not data else catalog.shaped(data)
                rows = [(path, i, None, *catalog.normalized(r, i, source)) for i, (r, source) in enumerate(found)]
            except (AttributeError, TypeError, ValueError) as e:
                rows, error = [], f"not a rule: {e}"
            out += rows if error is None else [(path, 0, error, *nothing)]
        yield pd.DataFrame(out, columns=names, dtype=object)


def rule_files(spark: SparkSession, path: str, profile: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules of a tree of YAML files, as catalog.SCHEMA in the order of paths, and (path, error) of the files that aren't rules even after a repair of their description.

    Files are read and parsed by executors. Empty files give nothing. Only the numbering, of keys, is one task's."""
    read = bodies(spark, path, profile).withColumn("mended", repaired(F.col("body"))).mapInPandas(_rules_of, _READ)
    good = read.where("error is null")
    order = good.select("path", "pos").withColumn("load_order", F.row_number().over(Window.orderBy("path", "pos")) - 1)
    names = [c.split()[0] for c in catalog.SCHEMA.split(", ")]
    return good.drop("load_order").join(order, ["path", "pos"]).select(*names), read.where("error is not null").select("path", "error")
