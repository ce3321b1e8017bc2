"""Unified diffs as relations: lines, patches, summaries.

Input is diffs(diff_id, raw_diff). A diff's lines are numbered and grouped by running sums within the diff; nothing crosses
diffs, so every operator needs at most one exchange, by diff_id."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREAKS = "\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029"
NEWLINE = f"\\r\\n|[{BREAKS}]"
#: In a whole text: its header lines, and the signs of added and of removed lines. What is rare is asked for first, then whether a line begins there.
HEADERS = f"(?=[d+-])(?<![^{BREAKS}])(?:diff --git|\\+\\+\\+ |--- )[^{BREAKS}]*"
ADDED, REMOVED = f"\\+(?<![^{BREAKS}]\\+)(?!\\+\\+)", f"-(?<![^{BREAKS}]-)(?!--)"

# Change types and languages by extension.
LOGIC, CONFIG, DOC = (".ts", ".py", ".go", ".java"), (".json", ".yaml", ".yml"), (".md", ".txt")
LANGUAGES = {
    "java": (".java",), "python": (".py",), "go": (".go",), "javascript": (".js", ".jsx"), "typescript": (".ts", ".tsx"), "cpp": (".cpp", ".cc", ".cxx", ".h", ".hpp"), "c": (".c",),
}


def is_json(raw: Column) -> Column:
    """The text is a JSON answer instead of a diff."""
    return F.coalesce(F.trim(raw).rlike("^[\\[{]"), F.lit(False))


def explode_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, pos, line); texts that are JSON have none.

    The text is split once: what a last newline leaves behind goes before the split, so that no row of a line needs the whole text."""
    rows = diffs.where(~is_json(F.col("raw_diff")) & (F.col("raw_diff") != ""))
    # outer, as an inner explode would have the text split twice, once to see whether it has lines; it always has
    return rows.select("diff_id", F.posexplode_outer(F.split(F.regexp_replace("raw_diff", f"(?:{NEWLINE})\\z", ""), NEWLINE, -1)).alias("pos", "line"))


def _path(line: Column, marker: str) -> Column:
    return F.regexp_replace(F.trim(F.substr(line, F.lit(5))), "^[ab]/", "")


def grouped(diffs: DataFrame) -> DataFrame:
    """explode_lines with grp (which git header the line is under) and the headers' paths."""
    w = Window.partitionBy("diff_id").orderBy("pos")
    rows = explode_lines(diffs).withColumn("grp", F.sum(F.col("line").startswith("diff --git").cast("int")).over(w))
    plus, minus = F.col("line").startswith("+++ "), F.col("line").startswith("--- ")
    null = F.trim(F.substr(F.col("line"), F.lit(5))) == "/dev/null"
    return rows.withColumns({"plus_path": F.when(plus & ~null, _path(F.col("line"), "+")), "minus_path": F.when(minus & ~null, _path(F.col("line"), "-")), "from_null": minus & null})


def _patch_file() -> Column:
    """Over a group of lines: the last +++ path, else the first --- path."""
    return F.coalesce(F.max_by("plus_path", F.when(F.col("plus_path").isNotNull(), F.col("pos"))), F.min_by("minus_path", F.when(F.col("minus_path").isNotNull(), F.col("pos"))))


def patch_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, grp, file, pos, line): lines with the file of their patch; lines without a file are left out. One exchange, by diff_id."""
    w = Window.partitionBy("diff_id", "grp")
    plus, minus = F.max_by("plus_path", F.when(F.col("plus_path").isNotNull(), F.col("pos"))).over(w), F.min_by("minus_path", F.when(F.col("minus_path").isNotNull(), F.col("pos"))).over(w)
    return grouped(diffs).withColumn("file", F.coalesce(plus, minus)).where("file is not null").select("diff_id", "grp", "file", "pos", "line")


def file_patches(diffs: DataFrame) -> DataFrame:
    """(diff_id, grp, file, patch, is_new): the last +++ path, else the first --- path; groups without a path are dropped."""
    g = grouped(diffs)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")
    return g.groupBy("diff_id", "grp").agg(_patch_file().alias("file"), text.alias("patch"), F.max("from_null").alias("is_new")).where("file is not null")


def diff_files(diffs: DataFrame) -> DataFrame:
    """(diff_id, files): distinct current files at each +++ line, in order of appearance."""
    g = grouped(diffs)
    w = Window.partitionBy("diff_id", "grp").orderBy("pos")
    # the current file: the last +++ path so far in the group, else its first --- path
    now = g.withColumn("now", F.coalesce(F.last("plus_path", True).over(w), F.first("minus_path", True).over(w)))
    seen = now.where(F.col("line").startswith("+++ ") & F.col("now").isNotNull()).groupBy("diff_id", "now").agg(F.min("pos").alias("pos"))
    return seen.groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "now"))), lambda x: x.now).alias("files"))


def stats(line: Column) -> tuple[Column, Column]:
    plus = F.count_if(line.startswith("+") & ~line.startswith("+++"))
    return plus, F.count_if(line.startswith("-") & ~line.startswith("---"))


def diff_stats(diffs: DataFrame) -> DataFrame:
    """(diff_id, n_add, n_del, n_lines)."""
    add, gone = stats(F.col("line"))
    return explode_lines(diffs).groupBy("diff_id").agg(add.cast("long").alias("n_add"), gone.cast("long").alias("n_del"), F.count("*").alias("n_lines"))


def change_type(file: Column) -> Column:
    ends = lambda xs: functools.reduce(lambda a, b: a | b, [file.endswith(x) for x in xs])
    return F.when(ends(CONFIG), "config").when(ends(LOGIC), "logic").when(ends(DOC), "doc").otherwise("other")


def language(file: Column) -> Column:
    ext = F.lower(F.regexp_extract(file, "(\\.[^./]*)$", 1))
    out = None
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts), name) if out is None else out.when(ext.isin(*exts), name)
    return out.otherwise("unknown")


def _group_paths(lines: Column) -> Column:
    """(seen, new, file) of the +++ and --- lines of one git header: current files at its +++ lines, first ones only, the file of a patch from /dev/null, and of any."""
    path = lambda x: F.trim(F.substr(x, F.lit(5)))
    told = F.transform(F.transform(lines, lambda x: F.struct(x.startswith("+").alias("plus"), path(x).alias("p"))), lambda x: F.struct(
        F.when(x["plus"], F.when(x["p"] == "/dev/null", "Z").otherwise("P")).otherwise(F.when(x["p"] == "/dev/null", "N").otherwise("M")).alias("k"), F.regexp_replace(x["p"], "^[ab]/", "").alias("p")))
    of = lambda xs, k: F.transform(F.filter(xs, lambda x: x["k"] == k), lambda x: x["p"])
    parts = F.transform(F.array(told), lambda xs: F.struct(F.array_join(F.transform(xs, lambda x: x["k"]), "").alias("kinds"), of(xs, "P").alias("plus"), F.get(of(xs, "M"), F.lit(0)).alias("minus")))
    # a +++ /dev/null has the last +++ path, which was seen before, else the first --- path so far
    none = F.array().cast("array<string>")
    first = lambda g: F.when(g["kinds"].rlike("^[^P]*M[^P]*Z"), F.array(g["minus"])).otherwise(none)
    file = lambda g: F.coalesce(F.get(g["plus"], F.size(g["plus"]) - 1), g["minus"])
    return F.get(F.transform(parts, lambda g: F.struct(F.concat(first(g), g["plus"]).alias("seen"), F.when(g["kinds"].contains("N"), file(g)).alias("new"), file(g).alias("file"))), F.lit(0))


def patch_arrays(diffs: DataFrame) -> DataFrame:
    """(diff_id, patches): an array of (grp, file, lines) by git header, file null without a path. One projection: a text is split at its git headers."""
    git = f"(?=d)(?<![^{BREAKS}])(?=diff --git)"
    text = F.when(~is_json(F.col("raw_diff")) & (F.col("raw_diff") != ""), F.col("raw_diff"))
    parts = F.transform(F.split("text", git, -1), lambda g, i: F.struct((i + F.col("text").startswith("diff --git").cast("int")).cast("long").alias("grp"), F.split(g, NEWLINE, -1).alias("lines")))
    paths = lambda lines: _group_paths(F.filter(lines, lambda x: x.startswith("+++ ") | x.startswith("--- ")))
    return diffs.select("diff_id", text.alias("text")).select("diff_id", F.transform(parts, lambda g: F.struct(g["grp"].alias("grp"), paths(g["lines"])["file"].alias("file"), g["lines"].alias("lines"))).alias("patches"))


def summaries(diffs: DataFrame) -> DataFrame:
    """(diff_id, raw_diff, files, new_files, n_add, n_del, change_types): what rules see of a diff.

    One projection without an exchange: a text's header lines are found in it, split by git headers and told apart; nothing is made of its other lines."""
    text = F.when(~is_json(F.col("raw_diff")), F.col("raw_diff"))
    heads = F.array_join(F.regexp_extract_all("text", F.lit(HEADERS), F.lit(0)), "\n")
    groups = F.transform(F.split(heads, "(?<![^\n])diff --git[^\n]*", -1), lambda g: _group_paths(F.filter(F.split(g, "\n", -1), lambda x: x != "")))
    count = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    out = diffs.select("diff_id", "raw_diff", text.alias("text")).select("diff_id", "raw_diff", groups.alias("groups"), count(ADDED).alias("n_add"), count(REMOVED).alias("n_del"))
    files, new = F.array_distinct(F.flatten(F.transform("groups", lambda g: g["seen"]))), F.array_compact(F.transform("groups", lambda g: g["new"]))
    out = out.select("diff_id", "raw_diff", F.coalesce(files, none).alias("files"), F.coalesce(new, none).alias("new_files"), "n_add", "n_del")
    return out.withColumn("change_types", F.array_sort(F.array_distinct(F.transform("files", change_type))))


def mostly_new(n_add: Column, n_del: Column, n_new: Column, n_files: Column) -> Column:
    total = n_add + n_del
    return ((total > 10) & (n_del / F.nullif(total, F.lit(0)) < 0.1)) | F.coalesce(n_new / F.nullif(n_files, F.lit(0)) > 0.8, F.lit(False))


def first_added(diffs: DataFrame) -> DataFrame:
    """(diff_id, position, line): index and new-file line number of the first added line of a diff, counting from each hunk's start."""
    w = Window.partitionBy("diff_id").orderBy("pos")
    rows = explode_lines(diffs).withColumn("hunk", F.when(F.col("line").startswith("@@"), F.regexp_extract("line", "\\+(\\d+)", 1).cast("int")))
    rows = rows.withColumn("h", F.sum((F.col("hunk").isNotNull()).cast("int")).over(w))
    inside = Window.partitionBy("diff_id", "h").orderBy("pos")
    counts = (~F.col("line").startswith("-") & F.col("hunk").isNull()).cast("int")
    at = F.first("hunk", True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.sum(counts).over(inside) - 1
    rows = rows.withColumn("new_line", at)
    added = rows.where(F.col("line").startswith("+") & ~F.col("line").startswith("+++") & (F.col("h") > 0))
    return added.groupBy("diff_id").agg(F.min("pos").alias("position"), F.min_by("new_line", "pos").cast("int").alias("line"))


def patch_positions(diffs: DataFrame) -> DataFrame:
    """(diff_id, grp, file, position, line): in each patch the place, from 1 on, of its first added line, and that line's number in the new file.

    A patch without one gives its last hunk's place (1 without hunks) and the number that its last line leads to."""
    numbered = F.transform(F.split("patch", "\n", -1), lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    added = F.get(F.filter("l", lambda r: r["x"].startswith("+") & ~r["x"].startswith("+++")), F.lit(0))["i"]
    rows = file_patches(diffs).select("diff_id", "grp", "file", numbered.alias("l")).withColumn("first", added)
    rows = rows.withColumn("l", F.when(F.col("first").isNull(), F.col("l")).otherwise(F.slice("l", F.lit(1), F.greatest(F.col("first") - 1, F.lit(0)))))
    rows = rows.withColumn("hunk", F.element_at(F.concat(F.array(F.struct(F.lit(1).alias("i"), F.lit("").alias("x"))), F.filter("l", lambda r: r["x"].startswith("@@"))), -1))
    start = F.nullif(F.regexp_extract("hunk.x", "\\+(\\d+)", 1), F.lit("")).cast("int")
    seen = F.size(F.filter("l", lambda r: (r["i"] > F.col("hunk.i")) & ~(r["x"].startswith("-") & ~r["x"].startswith("---"))))
    return rows.select("diff_id", "grp", "file", F.coalesce("first", "hunk.i").alias("position"), F.coalesce(start + seen, F.lit(1)).alias("line"))


def rebuild(changes: DataFrame) -> DataFrame:
    """Unified diffs of changes(diff_id, pos, old_path, new_path, is_new, is_deleted, is_renamed, body)."""
    head = F.concat(F.lit("diff --git a/"), "old_path", F.lit(" b/"), "new_path", F.lit("\n"))
    old = F.when(F.col("is_new"), "--- /dev/null").otherwise(F.concat(F.lit("--- a/"), "old_path"))
    new = F.when(F.col("is_deleted"), "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), "new_path"))
    moved = F.when(F.col("is_renamed"), F.concat(F.lit("rename from "), "old_path", F.lit("\nrename to "), "new_path", F.lit("\n"))).otherwise("")
    text = F.concat(head, moved, old, F.lit("\n"), new, F.lit("\n"), "body")
    return changes.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x.t), "\n").alias("raw_diff"))


def by_digest(diffs: DataFrame) -> DataFrame:
    """(digest, n, first_id): equal texts once, by their SHA-1."""
    return diffs.groupBy(F.sha1("raw_diff").alias("digest")).agg(F.count("*").alias("n"), F.min("diff_id").alias("first_id"))


def unmemoised(diffs: DataFrame, memo: DataFrame) -> DataFrame:
    """The diffs whose digest memo(digest) lacks, one a digest."""
    return diffs.withColumn("digest", F.sha1("raw_diff")).join(memo.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
