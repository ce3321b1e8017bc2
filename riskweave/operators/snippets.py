"""Snippets: one side of a patch as a stream of tokens across its lines, and what needs more than a line.

A side is lexed as one text, so comments, calls and declarations may span lines; a text that a Java lexer would reject has no tokens. Tokens
are rows with a position: neighbours are window offsets, contexts are frames of positions, and the type of a variable at a call is the latest
declaration before it (an as-of join, as one window over declarations and calls). Whether a side is a class body, a method body or
neither is told by a pushdown automaton folded over its tokens. All windows are within a side of a patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = ["diff_id", "grp", "file", "side"]

LEXEME = (
    "/\\*[\\s\\S]*?\\*/|/\\*[\\s\\S]*|//[^\\n]*|\\n|\"[^\"\\\\\\n]*(?:\\\\.[^\"\\\\\\n]*)*\"|'[^'\\\\\\n]*(?:\\\\.[^'\\\\\\n]*)*'|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][0-9A-Za-z_.]*"
    "|\\+\\+|--|[+*/%&|^!=<>-]=|&&|\\|\\||->|::|[^\\sA-Za-z0-9_$]"
)
# Words of the language, and of the predicates.
BASIC_TYPES = ["boolean", "byte", "char", "double", "float", "int", "long", "short"]
KEYWORDS = [
    "abstract", "assert", "break", "case", "catch", "class", "const", "continue", "default", "do", "else", "enum", "extends", "final", "finally", "for", "goto", "if", "implements", "import", "instanceof", "interface",
    "native", "new", "package", "private", "protected", "public", "return", "static", "strictfp", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "try", "void", "volatile", "while",
    "true", "false", "null",
]
SQL_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "JOIN", "TABLE", "CREATE", "DROP", "ALTER", "QUERY", "SQL"]
CONCATENATIONS = ["concat", "append", "+"]
LOOK_BACK = 20
#: Words that begin a statement, and words that begin a member of a class, where a unit of code begins.
STATEMENTS = ["if", "for", "while", "do", "switch", "try", "return", "throw", "break", "continue", "else", "catch", "finally", "assert", "new", "this", "super", "case", "default"]
MEMBERS = ["public", "private", "protected", "static", "abstract", "transient", "volatile", "native"]


def sides(lines: DataFrame) -> DataFrame:
    """(diff_id, grp, file, side, text) of lines(..., n, text), numbered from 1 without gaps."""
    return lines.groupBy(*SIDE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("text"))


def _word(w: Column) -> Column:
    return w.rlike("^[A-Za-z_$]") & ~w.isin(*KEYWORDS)


def stream(sides: DataFrame) -> DataFrame:
    """(diff_id, grp, file, side, i, n, w): tokens by position, with their line; none for a side that can't be lexed."""
    rows = sides.select(*SIDE, F.posexplode_outer(F.regexp_extract_all("text", F.lit(LEXEME), F.lit(0))).alias("p", "w")).where("w is not null")
    order = Window.partitionBy(*SIDE).orderBy("p")
    breaks = F.length(F.regexp_replace("w", "[^\\n]", ""))
    bad = F.col("w").isin('"', "'", "#", "\\", "`") | (F.col("w").startswith("/*") & ~F.col("w").rlike("^/\\*[\\s\\S]*\\*/$"))
    rows = rows.withColumns({"n": F.lit(1) + F.coalesce(F.sum(breaks).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "bad": F.max(bad).over(Window.partitionBy(*SIDE))})
    kept = rows.where(~F.col("bad") & (F.col("w") != "\n") & ~F.col("w").startswith("//") & ~F.col("w").startswith("/*"))
    return kept.select(*SIDE, F.row_number().over(order).alias("i"), F.col("n").cast("int").alias("n"), "w")


def _near(c: str, k: int) -> Column:
    return F.lag(c, k).over(Window.partitionBy(*SIDE).orderBy("i"))


def sql_concatenations(tokens: DataFrame) -> DataFrame:
    """(diff_id, grp, file, side, n): lines that join texts, with a word of SQL among the LOOK_BACK tokens before."""
    back = Window.partitionBy(*SIDE).orderBy("i").rowsBetween(-LOOK_BACK, -1)
    near = F.max(F.upper("w").isin(*SQL_WORDS)).over(back)
    return tokens.withColumn("near", near).where(F.col("w").isin(*CONCATENATIONS) & F.col("near")).select(*SIDE, "n").distinct()


def declarations(tokens: DataFrame) -> DataFrame:
    """(diff_id, grp, file, side, i, n, var, type): a type, type arguments or none, a name, and then = ; or a comma."""
    order = Window.partitionBy(*SIDE).orderBy("i")
    level = F.sum(F.when(F.col("w") == "<", 1).when(F.col("w") == ">", -1).otherwise(0)).over(order)
    t = tokens.withColumns({"before": _near("w", 1), "after": _near("w", -1), "level": level + (F.col("w") == ">").cast("int")})
    # what stands before the < that a > closes: the last one of its level
    t = t.withColumn("opened", F.last(F.when(F.col("w") == "<", F.col("before")), True).over(Window.partitionBy(*SIDE, "level").orderBy("i")))
    t = t.withColumn("type", F.when(F.col("before") == ">", _near("opened", 1)).otherwise(F.col("before")))
    named = _word(F.col("w")) & ~F.col("w").isin(*BASIC_TYPES) & F.col("after").isin("=", ";", ",")
    return t.where(named & _word(F.col("type"))).select(*SIDE, "i", "n", F.col("w").alias("var"), "type")


def calls(tokens: DataFrame) -> DataFrame:
    """(diff_id, grp, file, side, i, n, name, qualifier): a name before a parenthesis that isn't declared or created there; the simple name before its point."""
    t = tokens.withColumns({"before": _near("w", 1), "after": _near("w", -1), "q": _near("w", 2), "q0": _near("w", 3)})
    declared = F.coalesce((F.col("before") == "new") | _word(F.col("before")) | F.col("before").isin(">", "]", "void"), F.lit(False))
    simple = (F.col("before") == ".") & _word(F.col("q")) & ~F.coalesce(F.col("q0") == ".", F.lit(False))
    return t.where(_word(F.col("w")) & (F.col("after") == "(") & ~declared).select(*SIDE, "i", "n", F.col("w").alias("name"), F.when(simple, F.col("q")).alias("qualifier"))


def typed_calls(tokens: DataFrame) -> DataFrame:
    """(diff_id, grp, file, side, n, name, var, type): calls on variables, with the latest declaration before each."""
    both = declarations(tokens).select(*SIDE, "i", "n", "var", "type", F.lit(None).cast("string").alias("name")).unionByName(
        calls(tokens).where("qualifier is not null").select(*SIDE, "i", "n", F.col("qualifier").alias("var"), F.lit(None).cast("string").alias("type"), "name"))
    as_of = F.last("type", True).over(Window.partitionBy(*SIDE, "var").orderBy("i"))
    return both.withColumn("type", as_of).where("name is not null and type is not null").select(*SIDE, "n", "name", "var", "type")


def wrappers(tokens: DataFrame) -> DataFrame:
    """(diff_id, grp, file, side, wrapper): class if the side can stand in a class, else method if it can stand in a method, else fallback.

    The automaton's stack holds open brackets. Outside all of them, units end at a semicolon or a closing brace: statements, calls and
    assignments don't stand in a class, members and methods don't stand in a method. What is open at the end fits neither."""
    start = F.struct(F.lit("").alias("stack"), F.lit(False).alias("bad"), F.lit(False).alias("statement"), F.lit(False).alias("member"), F.lit("").alias("last"), F.lit(False).alias("pair"), F.lit(False).alias("equal"), F.lit(False).alias("paren"), F.lit(False).alias("into"))

    def step(a: Column, x: Column) -> Column:
        w, top, outer = x["w"], F.right(a["stack"], F.lit(1)), a["stack"] == ""
        opening, closing = w.isin("(", "[", "{"), w.isin(")", "]", "}")
        fits = ((w == ")") & (top == "(")) | ((w == "]") & (top == "[")) | ((w == "}") & (top == "{"))
        stack = F.when(opening, F.concat(a["stack"], w)).when(closing & fits, F.left(a["stack"], F.length(a["stack"]) - 1)).otherwise(a["stack"])
        begins = outer & (a["last"] == "")
        # a block ends its unit, but for an initialiser in braces
        ends = (outer & (w == ";")) | ((w == "}") & (stack == "") & ~a["into"])
        pair = a["pair"] | (outer & _word(w) & (_word(a["last"]) | a["last"].isin(">", "]", "void")))
        first_equal = outer & (w == "=") & ~a["equal"]
        first_paren = outer & (w == "(") & ~a["paren"] & ~a["equal"]
        called = first_paren & ~a["pair"] & (a["last"] != "synchronized") & ~a["last"].startswith("@")
        locks = first_paren & (a["last"] == "synchronized")
        method = outer & (w == "{") & a["pair"] & a["paren"] & ~a["equal"]
        blank = F.lit("")
        return F.struct(
            stack.alias("stack"),
            (a["bad"] | (closing & ~fits)).alias("bad"),
            (a["statement"] | (begins & (w.isin(*STATEMENTS) | w.isin("++", "--", "(", "{"))) | called | locks | (first_equal & ~a["pair"]) | (outer & w.isin("++", "--", "+=", "-=", "*=", "/="))).alias("statement"),
            (a["member"] | (begins & w.isin(*MEMBERS)) | method).alias("member"),
            F.when(ends, blank).when(outer | (stack == ""), w).otherwise(a["last"]).alias("last"),
            F.when(ends, F.lit(False)).otherwise(pair).alias("pair"),
            F.when(ends, F.lit(False)).otherwise(a["equal"] | first_equal).alias("equal"),
            F.when(ends, F.lit(False)).otherwise(a["paren"] | first_paren).alias("paren"),
            F.when(ends, F.lit(False)).otherwise(a["into"] | first_equal).alias("into"),
        )

    whole = tokens.groupBy(*SIDE).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("x")).withColumn("end", F.aggregate("x", start, step))
    broken = F.col("end.bad") | (F.col("end.stack") != "") | (F.col("end.last") != "")
    kind = F.when(broken, "fallback").when(~F.col("end.statement"), "class").when(~F.col("end.member"), "method").otherwise("fallback")
    return whole.select(*SIDE, kind.alias("wrapper"))


def parsed_only(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of sides that stand in a class or a method."""
    return rows.join(wrappers(tokens).where("wrapper <> 'fallback'").select(*SIDE), SIDE, "left_semi")


def atomic_sets(tokens: DataFrame) -> DataFrame:
    """(diff_id, grp, file, side, n, var): calls of set on variables of an Atomic type, of sides that parse."""
    found = typed_calls(tokens).where("name = 'set' and type like 'Atomic%'")
    return parsed_only(found, tokens).select(*SIDE, "n", "var").distinct()


def fallback_types(tokens: DataFrame) -> DataFrame:
    """(diff_id, grp, file, side, var, type): the last declaration of each variable, of sides that don't parse."""
    rows = declarations(tokens).join(wrappers(tokens).where("wrapper = 'fallback'").select(*SIDE), SIDE, "left_semi")
    return rows.groupBy(*SIDE, "var").agg(F.max_by("type", "i").alias("type"))
