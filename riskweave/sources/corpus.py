"""Corpora of diffs derived from the driver's tables, by arithmetic that Spark and DuckDB do alike.

Every function gives a DataFrame; CTE holds the same definition in DuckDB SQL. One diff is one order, one line one lineitem;
a diff has one or two patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = [
    "synchronized (lock) {",
    "private volatile boolean ready;",
    "lock.lock();",
    "Thread.sleep(5000);",
    "private ConcurrentHashMap<String, Long> cache = new ConcurrentHashMap<>();",
    "private HashMap<String, Long> cache = new HashMap<>();",
    "private static HashMap<String, String> shared = new HashMap<>();",
    "} catch (Exception e) {",
    "} catch (Exception e) {}",
    "String password = \"password=abcdef0123456789\";",
    "String query = \"SELECT id FROM users WHERE name = \" + name;",
    "MessageDigest md = MessageDigest.getInstance(\"MD5\");",
    "Runtime.getRuntime().exec(command);",
    "int pageNo = request.getInt();",
    "String s = encode(input);",
    "ExecutorService pool = Executors.newFixedThreadPool(1);",
    "pool = new ThreadPoolExecutor(0, Integer.MAX_VALUE, 60L);",
    "pool = new ThreadPoolExecutor(4, 8, 60L);",
    "queue = new LinkedBlockingQueue<>();",
    "while (true) {",
    "try (InputStream in = new FileInputStream(path)) {",
    "cache.evict(key);",
    "client.setTimeout(3000);",
    "if (a.equals(b)) {",
    "if (a == b) {",
    "if (value == null) {",
    "return future.get();",
    "public String load(String key, int count) {",
    "public String load(String key) {",
    "Reader r = new FileReader(path);",
    "Connection c = DriverManager.getConnection(url);",
    "throw new IllegalStateException(\"bad\");",
    "public void run() throws IOException {",
    "Long total = counts.get(key);",
    "order.getUser().getName();",
    "return list;",
    "for (Item item : items) {",
    "items.remove(item);",
    "List<String> names = Arrays.asList(raw);",
    "names.add(extra);",
    "@Transactional",
    "@Deprecated",
    "private static final long serialVersionUID = 2L;",
    "map = stream.collect(Collectors.toMap(a, b));",
    "latch.countDown();",
    "go worker.run(ch)",
    "ch := make(chan int)",
    "err = exec.Command(name)",
    "element.innerHTML = value",
    "eval(code)",
    "import os",
    "except Exception:",
    "http.Get(\"http://example.com/\" + id)",
    "// riskweave-ignore: runtime.concurrency.lock_removed",
    "AtomicLong hits = new AtomicLong();",
    "hits.set(0L);",
    "Long hits = 0L;",
    "int last = rows[rows.length - 1];",
    "ArrayList raw = new ArrayList<>();",
    "public Service(String name)",
    "List<String> none = Collections.emptyList();",
    "if (!map.containsKey(key)) {",
    "map.put(key, value);",
    "public interface Loader {",
    "protected volatile int count;",
    "sql.append(id); /* joined",
    "over lines */ sql.append(name).execute(",
    "Map<String, List<Long>> byName = load(",
    "int total = a + b;",
    "// nothing to see",
    "",
]
#: First lines of every seventeenth text, before any header: patterns that are anchored without multi-line mode see only these.
FIRST = [
    "+ InputStream in = new FileInputStream(path);",
    "+ Connection c = DriverManager.getConnection(url);",
    "+ ExecutorService pool = Executors.newFixedThreadPool(2);",
    "+ Reader r = new FileReader(paths.get(0).get());",
    "+ throw new IllegalStateException(text);",
    "+ Writer w = new FileWriter(files.get ());",
    "+ Long total = counts.get(key) + 1;",
    "+ List<String> none = Collections.emptyList();",
]
DIRS = ["src/service/", "src/controller/", "src/dto/", "lib/", "app/api/", "", "src/entity/", "docs/"]
EXTS = [".java", ".py", ".go", ".js", ".ts", ".cpp", ".md", ".yaml"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rule ids that derived findings and runs take.
RULE_IDS = [
    "security.hardcoded_secret", "runtime.concurrency.lock_removed", "api.public_method_removed", "exception.swallowed", "null.return_ignored", "collection.raw_type", "resource.closeable_leak", "absolute.security.http_url",
    "python.security.code_injection", "cpp.resource.leak", "go.runtime.panic_added", "javascript.security.xss",
]


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, patch_no, file, pos, sign, text)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = li.withColumn("pos", pos).withColumn("patch_no", F.when(F.col("pos") > 4, 1).otherwise(0))
    k = F.col("l_orderkey")
    path = F.concat(pick(DIRS, k + F.col("patch_no")), F.lit("mod"), (k % 97).cast("string"), pick(EXTS, k * 3 + F.col("patch_no") * 5))
    sign = pick(["+", "-", " "], F.col("l_suppkey") + F.col("l_linenumber"))
    text = pick(LINES, k * 7 + F.col("pos"))
    return rows.select(k.cast("long").alias("diff_id"), "patch_no", path.alias("file"), "pos", sign.alias("sign"), text.alias("text"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, raw_diff): unified diffs. Every seventh diff is of a new file, every eleventh of a deleted one, every thirteenth lacks git headers, every
    seventeenth begins with an added line before all headers."""
    lines = code_lines(spark, sf_dir).withColumn("line", F.concat("sign", F.lit(" "), "text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")
    patch = lines.groupBy("diff_id", "patch_no", "file").agg(body.alias("body"), F.count("*").cast("string").alias("n"))
    f, d = F.col("file"), F.col("diff_id")
    git = F.when(d % 13 == 0, "").otherwise(F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\n")))
    old = F.when(d % 7 == 0, "--- /dev/null").otherwise(F.concat(F.lit("--- a/"), f))
    new = F.when((d % 11 == 0) & (d % 7 != 0), "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), f))
    text = F.concat(git, old, F.lit("\n"), new, F.lit("\n@@ -10,"), "n", F.lit(" +10,"), "n", F.lit(" @@\n"), "body")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("patch_no", text.alias("text")))), lambda x: x.text), "\n")
    first = F.when(d % 17 == 0, F.concat(pick(FIRST, F.floor(d / 17)), F.lit("\n"))).otherwise("")
    return patch.groupBy("diff_id").agg(whole.alias("raw_diff")).select("diff_id", F.concat(first, "raw_diff").alias("raw_diff"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: list[str], index: str) -> str:
    return f"{_sql_list(values)}[CAST(({index}) % {len(values)} + 1 AS INTEGER)]"


CTE = f"""code_lines AS (
  SELECT CAST(l_orderkey AS BIGINT) AS diff_id, patch_no,
    {_sql_pick(DIRS, "l_orderkey + patch_no")} || 'mod' || CAST(l_orderkey % 97 AS VARCHAR) || {_sql_pick(EXTS, "l_orderkey * 3 + patch_no * 5")} AS file,
    pos, {_sql_pick(["+", "-", " "], "l_suppkey + l_linenumber")} AS sign, {_sql_pick(LINES, "l_orderkey * 7 + pos")} AS text
  FROM (SELECT *, CASE WHEN pos > 4 THEN 1 ELSE 0 END AS patch_no FROM (
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS pos FROM lineitem))),
diff_patches AS (
  SELECT diff_id, patch_no, CASE WHEN diff_id % 13 = 0 THEN '' ELSE 'diff --git a/' || file || ' b/' || file || chr(10) END
    || CASE WHEN diff_id % 7 = 0 THEN '--- /dev/null' ELSE '--- a/' || file END || chr(10)
    || CASE WHEN diff_id % 11 = 0 AND diff_id % 7 <> 0 THEN '+++ /dev/null' ELSE '+++ b/' || file END || chr(10)
    || '@@ -10,' || CAST(count(*) AS VARCHAR) || ' +10,' || CAST(count(*) AS VARCHAR) || ' @@' || chr(10)
    || string_agg(sign || ' ' || text, chr(10) ORDER BY pos) AS text
  FROM code_lines GROUP BY diff_id, patch_no, file),
diffs AS (SELECT diff_id, CASE WHEN diff_id % 17 = 0 THEN {_sql_pick(FIRST, "diff_id // 17")} || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY patch_no) AS raw_diff FROM diff_patches GROUP BY diff_id)"""
