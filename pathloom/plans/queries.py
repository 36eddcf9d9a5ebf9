"""The registered queries over the driver's tables, and their SQL twins.

Only ``pages`` holds path syntax. The other formats get carrier documents: texts
projected from the columns of a table, row by row. Their SQL twins compute the
expected paths from those columns and not from the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, errors, formats
from ..functions import paths as P
from ..functions import predicates as Q
from ..functions.text import utf16_length
from ..operators import admission, metrics, post, profile, resolve, settings, validate
from ..operators.extract import extract
from ..operators.trees import extract_tree
from ..sources import documents as sources
from . import engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_table(read(spark, sf_dir, "pages"), "html", doc_id="page_id", language_id=F.lit("html"), uri="url")


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(pages(spark, sf_dir), "html")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a few bytes that grow to long texts, dealt over all tasks before they do: a file of keys has few splits."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ------------------------------------------------------------------------ html

_ATTR = "(src|href|data|action|poster|background|cite|formaction|icon|manifest|srcset)\\s*=\\s*[\"''']([^\"''']+)[\"''']".replace("'''", "''")
_CLASS = """CASE WHEN {v} LIKE 'http://%' OR {v} LIKE 'https://%' OR {v} LIKE '//%' THEN 'url' WHEN {v} LIKE '/%' THEN 'absolute'
  WHEN {v} LIKE './%' OR {v} LIKE '../%' THEN 'relative' WHEN {v} LIKE '#%' THEN 'unknown' WHEN contains({v}, '.') THEN 'file' ELSE 'unknown' END"""
HTML_CTE = f"""
lines AS (
  SELECT page_id AS doc_id, unnest(string_split(html, chr(10))) AS text, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages
), found AS (
  SELECT doc_id, line, regexp_extract_all(text, '{_ATTR}', 0, 'i') AS f, regexp_extract_all(text, '{_ATTR}', 1, 'i') AS a,
    regexp_extract_all(text, '{_ATTR}', 2, 'i') AS v, regexp_split_to_array(text, '{_ATTR}', 'i') AS g FROM lines
), each AS (
  SELECT doc_id, line, i, lower(a[i]) AS attr, v[i] AS whole,
    1 + list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS col
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM found)
), parts AS (
  SELECT doc_id, line, i, 0 AS j, attr, col, whole AS value FROM each
    WHERE attr <> 'srcset' AND NOT (whole LIKE 'data:%' OR whole LIKE 'javascript:%')
  UNION ALL
  SELECT doc_id, line, i, j, attr, col, regexp_extract(trim(part), '^(\\S*)', 1) AS value
  FROM (SELECT doc_id, line, i, attr, col, unnest(string_split(whole, ',')) AS part, generate_subscripts(string_split(whole, ','), 1) AS j
    FROM each WHERE attr = 'srcset')
  WHERE regexp_extract(trim(part), '^(\\S*)', 1) <> '' AND NOT regexp_extract(trim(part), '^(\\S*)', 1) LIKE 'data:%'
), html AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, i, j) - 1 AS INTEGER) AS ordinal, value,
    {_CLASS.format(v="value")} AS path_type, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS "column", 'HTML ' || attr AS context
  FROM parts
)"""


@query(f"WITH {HTML_CTE} SELECT * FROM html")
def html_paths(spark, sf_dir):
    return html(spark, sf_dir)


@query(f"WITH {HTML_CTE} SELECT path_type, count(*) AS count FROM html GROUP BY path_type")
def html_type_counts(spark, sf_dir):
    return profile.types(html(spark, sf_dir))


@query(f"WITH {HTML_CTE} SELECT value, count(*) AS n FROM html GROUP BY value ORDER BY n DESC, value LIMIT 25")
def html_top_values(spark, sf_dir):
    return html(spark, sf_dir).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(25)


@query(f"WITH {HTML_CTE} SELECT count(*) AS count, count(DISTINCT value) AS \"unique\", count(*) - count(DISTINCT value) AS duplicates FROM html")
def path_summary(spark, sf_dir):
    return profile.summary(html(spark, sf_dir))


# -------------------------------------------------------------------- carriers

_PATHS = "doc_id, CAST(ordinal AS INTEGER) AS ordinal, value, path_type, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS \"column\", context"


@query(f"""SELECT {_PATHS} FROM (
  SELECT p_partkey AS doc_id, 0 AS ordinal, './p/' || p_partkey || '.jpg' AS value, 'relative' AS path_type, 1 AS line, 6 AS col, 'HTML srcset' AS context FROM part
  UNION ALL SELECT p_partkey, 1, '/p/' || p_partkey || '@2x.jpg', 'absolute', 1, 6, 'HTML srcset' FROM part
  UNION ALL SELECT p_partkey, 2, 'AAA' || p_partkey, 'unknown', 2, 6, 'HTML srcset' FROM part)""")
def html_srcset(spark, sf_dir):
    k = F.col("p_partkey")
    content = text('<img srcset="./p/', k, ".jpg 1x, /p/", k, '@2x.jpg 2x">\n<img srcset="data:image/png;base64,AAA', k, ' 1x">')
    return extract(sources.from_table(read(spark, sf_dir, "part").withColumn("c", content), "c", doc_id="p_partkey", language_id="html"), "html")


@query(f"""SELECT {_PATHS} FROM (
  SELECT p_partkey AS doc_id, 0 AS ordinal, './base' || p_partkey || '.css' AS value, 'relative' AS path_type, 1 AS line, 1 AS col, 'CSS @import' AS context FROM part
  UNION ALL SELECT p_partkey, 1, '/i/' || p_partkey || '.png', 'absolute', 3, 5, 'CSS url()' FROM part
  UNION ALL SELECT p_partkey, 2, '//cdn/' || p_partkey || '.svg', 'url', 3, 21 + length(p_partkey::VARCHAR), 'CSS url()' FROM part
  UNION ALL SELECT p_partkey, 3, 'img' || p_partkey, 'unknown', 4, 5, 'CSS url()' FROM part)""")
def css_paths(spark, sf_dir):
    k = F.col("p_partkey")
    content = text("@import './base", k, ".css'; a{b:url(lost.png)}\n@import url(lost.css);\na{b:url('/i/", k, ".png'), URL(//cdn/", k, ".svg)}\na{b:url( img", k, " ) url(\"data:x\")}")
    return extract(sources.from_table(read(spark, sf_dir, "part").withColumn("c", content), "c", doc_id="p_partkey", language_id="scss"), "css")


@query(f"""SELECT {_PATHS} FROM (
  SELECT o_orderkey AS doc_id, 0 AS ordinal, './i' || o_orderkey AS value, 'relative' AS path_type, 1 AS line, 25 + length(o_orderkey::VARCHAR) AS col, 'JS import' AS context FROM orders
  UNION ALL SELECT o_orderkey, 1, './r' || o_orderkey, 'relative', 1, 9, 'JS require' FROM orders
  UNION ALL SELECT o_orderkey, 2, 'http://h/' || o_orderkey, 'url', 2, 1, 'JS dynamic import' FROM orders
  UNION ALL SELECT o_orderkey, 3, 'C:/lib/' || o_orderkey, 'absolute', 3, 1, 'JS export' FROM orders)""")
def js_paths(spark, sf_dir):
    k = F.col("o_orderkey")
    content = text("const a=require('./r", k, "'); import b from './i", k, "';\nimport('http://h/", k, "'); import 'react';\nexport * from 'C:/lib/", k, "';\nimport $ from './lost';")
    return extract(sources.from_table(read(spark, sf_dir, "orders").withColumn("c", content), "c", doc_id="o_orderkey", language_id="typescript"), "javascript")


@query(f"""SELECT {_PATHS} FROM (
  SELECT c_custkey AS doc_id, 0 AS ordinal, './x/' || c_custkey AS value, 'relative' AS path_type, 2 AS line, 2 AS col, 'Environment variable: A' AS context FROM customer
  UNION ALL SELECT c_custkey, 1, 'C:\\d\\' || c_custkey || '.db', 'absolute', 3, 2, 'Environment variable: B' FROM customer
  UNION ALL SELECT c_custkey, 2, '/v/' || c_custkey, 'absolute', 4, 10, 'Environment variable: "./k.env"' FROM customer
  UNION ALL SELECT c_custkey, 3, './k.env', 'relative', 4, 1, 'Environment variable name' FROM customer
  UNION ALL SELECT c_custkey, 4, '/v/' || c_custkey, 'absolute', 4, 10, 'Environment variable: ./k.env' FROM customer
  UNION ALL SELECT c_custkey, 5, '1.2.' || c_custkey, 'file', 5, 2, 'Environment variable: V' FROM customer)""")
def dotenv_paths(spark, sf_dir):
    k = F.col("c_custkey")
    content = text("# c=./no\nA=./x/", k, "\n  B=\"C:\\\\d\\\\", k, ".db\"\n\"./k.env\"=/v/", k, "\nV=1.2.", k, "\nE=")
    return extract(sources.from_table(read(spark, sf_dir, "customer").withColumn("c", content), "c", doc_id="c_custkey", language_id="env"), "dotenv")


@query(f"""SELECT {_PATHS} FROM (
  SELECT s_suppkey AS doc_id, 0 AS ordinal, './a' || s_suppkey AS value, 'relative' AS path_type, 2 AS line, 2 AS col, 'CSV cell [2,2]' AS context FROM supplier
  UNION ALL SELECT s_suppkey, 1, 'extra/x' || s_suppkey, 'unknown', 2, 3, 'CSV cell [2,3]' FROM supplier
  UNION ALL SELECT s_suppkey, 2, '3.' || s_suppkey, 'file', 3, 3, 'CSV cell [3,3]' FROM supplier
  UNION ALL SELECT s_suppkey, 3, '../z' || s_suppkey, 'relative', 4, 2, 'CSV cell [4,2]' FROM supplier)""")
def csv_paths(spark, sf_dir):
    k = F.col("s_suppkey")
    content = text("name,path\n\nr1,./a", k, ",extra/x", k, '\n"q","/m n",3.', k, "\nword, ../z", k, " ")
    return extract_tree(sources.from_table(read(spark, sf_dir, "supplier").withColumn("c", content), "c", doc_id="s_suppkey", language_id="csv"), "csv")


_EVENT = ("event_id", "events")


def _event_tree(spark, sf_dir):
    k = F.col("event_id")
    content = text('{"b":"./x', k, '","2":"/two', k, '","1":["one', k, '.txt","a/b",{"c":"1.0.0"}],"n":null,"k/y":3,"d":"./dup","d":"../last', k, '"}')
    keys = dealt(read(spark, sf_dir, "events").select(k), "event_id")
    return sources.from_table(keys.withColumn("c", content), "c", doc_id="event_id", language_id="json")


@query(f"""SELECT {_PATHS} FROM (
  SELECT event_id AS doc_id, 0 AS ordinal, 'one' || event_id || '.txt' AS value, 'file' AS path_type, 1 AS line, 1 AS col, 'JSON 1.[0]' AS context FROM events
  UNION ALL SELECT event_id, 1, '/two' || event_id, 'absolute', 1, 1, 'JSON 2' FROM events
  UNION ALL SELECT event_id, 2, './x' || event_id, 'relative', 1, 1, 'JSON b' FROM events
  UNION ALL SELECT event_id, 3, '../last' || event_id, 'relative', 1, 1, 'JSON d' FROM events)""")
def json_paths(spark, sf_dir):
    return extract_tree(_event_tree(spark, sf_dir), "json")


@query(f"""SELECT {_PATHS} FROM (
  SELECT event_id AS doc_id, 0 AS ordinal, 'one' || event_id || '.txt' AS value, 'file' AS path_type, 1 AS line, 1 AS col, 'root.1[0]' AS context FROM events
  UNION ALL SELECT event_id, 1, 'a/b', 'unknown', 1, 1, 'root.1[1]' FROM events
  UNION ALL SELECT event_id, 2, '1.0.0', 'file', 1, 1, 'root.1[2].c' FROM events
  UNION ALL SELECT event_id, 3, '/two' || event_id, 'absolute', 1, 1, 'root.2' FROM events
  UNION ALL SELECT event_id, 4, './x' || event_id, 'relative', 1, 1, 'root.b' FROM events
  UNION ALL SELECT event_id, 5, 'k/y', 'unknown', 1, 1, 'root.key' FROM events
  UNION ALL SELECT event_id, 6, '../last' || event_id, 'relative', 1, 1, 'root.d' FROM events)""")
def collect_paths(spark, sf_dir):
    return extract_tree(_event_tree(spark, sf_dir), "tree")


@query(f"""SELECT {_PATHS} FROM (
  SELECT n_nationkey AS doc_id, 0 AS ordinal, './a ' || n_name AS value, 'relative' AS path_type, 1 AS line, 1 AS col, 'TOML value' AS context FROM nation
  UNION ALL SELECT n_nationkey, 1, 'x/' || n_name, 'unknown', 1, 1, 'TOML key' FROM nation
  UNION ALL SELECT n_nationkey, 2, 'C:\\' || n_name, 'absolute', 1, 1, 'TOML value' FROM nation)""")
def toml_paths(spark, sf_dir):
    k = F.col("n_name")
    content = text('p = "./a ', k, '"\nn = 3.14\n["x/', k, '"]\nl = ["C:\\\\', k, '", "plain"]\n')
    return extract_tree(sources.from_table(read(spark, sf_dir, "nation").withColumn("c", content), "c", doc_id="n_nationkey", language_id="toml"), "toml")


def _mixed(spark, sf_dir):
    """Carriers of all language ids, one a region and language."""
    languages = (*engine.LANGUAGES, "yaml", "ini")
    content = (
        F.when(F.col("l").isin("csv"), "n,./a/b").when(F.col("l") == "toml", 'a = "./a/b"').when(F.col("l").isin("dotenv", "env"), "A=./a/b")
        .when(F.col("l").isin("json", "jsonc"), '{"a":"./a/b"}').when(F.col("l") == "html", '<a href="./a/b">')
        .when(F.col("l").isin("css", "scss", "less"), "a{b:url(./a/b)}").otherwise("require('./a/b')")
    )
    rows = read(spark, sf_dir, "region").select("r_regionkey", F.posexplode(F.array(*map(F.lit, languages))).alias("i", "l"))
    return rows.select((F.col("r_regionkey") * 100 + F.col("i")).cast("long").alias("doc_id"), F.col("l").alias("language_id"), content.alias("content"))


_LANGS = "(SELECT unnest([" + ", ".join(f"'{x}'" for x in (*engine.LANGUAGES, "yaml", "ini")) + "]) AS l, unnest(range(16)) AS i)"


@query(f"""SELECT CAST(r_regionkey * 100 + i AS BIGINT) AS doc_id, l NOT IN ('yaml', 'ini') AS success,
  CAST(CASE WHEN l IN ('yaml', 'ini') THEN 0 ELSE 1 END AS BIGINT) AS n_paths FROM region, {_LANGS}""")
def dispatch_results(spark, sf_dir):
    return engine.extract_documents(_mixed(spark, sf_dir)).results


@query(f"""SELECT CAST(r_regionkey * 100 + i AS BIGINT) AS doc_id, 'format' AS category, 'info' AS severity,
  'Path extraction is not supported for ' || l || ' files. Supported formats: CSV, TOML, ENV, JS, TS, JSON, HTML, CSS.' AS message,
  'File type: ' || l AS context, false AS recoverable, 'none' AS recovery_action FROM region, {_LANGS} WHERE l IN ('yaml', 'ini')""")
def dispatch_errors(spark, sf_dir):
    return engine.extract_documents(_mixed(spark, sf_dir)).errors.drop("metadata")


# ------------------------------------------------------------- scalar functions


def variants(spark, sf_dir):
    """Five spellings of each page's address: (page_id, k, p)."""
    rest = F.regexp_replace("url", "^https?://", "")
    back = F.replace(rest, F.lit("/"), F.lit("\\"))
    spelled = F.array(
        F.col("url"), text("/", rest, "//a_b/Index.HTML/"), text("..\\", back, "\\x-y.tar.gz"), text("C:\\", back, "\\CON\\README"),
        text("page", F.col("page_id"), ".min.js"), text("src/page", F.col("page_id")),
    )
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(spelled).alias("k", "p"))


VARIANTS = r"""v AS (
  SELECT page_id, CAST(k AS INTEGER) AS k, p FROM (
    SELECT page_id, unnest(range(6)) AS k, unnest([url, '/' || r || '//a_b/Index.HTML/', '..\' || b || '\x-y.tar.gz', 'C:\' || b || '\CON\README',
      'page' || page_id || '.min.js', 'src/page' || page_id]) AS p
    FROM (SELECT *, replace(r, '/', '\') AS b FROM (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS r FROM pages)))
), s AS (SELECT *, regexp_replace(replace(p, '\', '/'), '/+', '/', 'g') AS c FROM v),
n AS (SELECT *, CASE WHEN length(c) > 1 AND c LIKE '%/' THEN left(c, length(c) - 1) ELSE c END AS norm FROM s),
f AS (SELECT *, CASE WHEN contains(norm, '/') THEN regexp_replace(norm, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(norm, '([^/]*)$', 1) AS file FROM n),
x AS (SELECT *, CASE WHEN contains(file, '.') THEN regexp_extract(file, '\.([^.]*)$', 1) ELSE '' END AS ext,
  CASE WHEN contains(file, '.') THEN regexp_replace(file, '\.[^.]*$', '') ELSE file END AS base FROM f)"""


@query(f"WITH {VARIANTS} SELECT page_id, k, norm AS normalized FROM x")
def path_normalize(spark, sf_dir):
    return variants(spark, sf_dir).select("page_id", "k", P.normalize("p").alias("normalized"))


@query(f"WITH {VARIANTS} SELECT page_id, k, dir AS directory, file AS filename, ext AS extension, base AS basename FROM x")
def path_components(spark, sf_dir):
    return variants(spark, sf_dir).select("page_id", "k", P.components("p").alias("c")).select("page_id", "k", "c.*")


@query(f"WITH {VARIANTS} SELECT page_id, k, CAST(len(list_filter(string_split(norm, '/'), lambda z: z <> '')) AS INTEGER) AS depth FROM x")
def path_depth(spark, sf_dir):
    return variants(spark, sf_dir).select("page_id", "k", P.depth("p").alias("depth"))


@query(f"WITH {VARIANTS} SELECT page_id, k, regexp_replace(p, '[a-zA-Z0-9]', 'X', 'g') AS pattern FROM x")
def path_pattern(spark, sf_dir):
    return variants(spark, sf_dir).select("page_id", "k", P.pattern("p").alias("pattern"))


_NAMING = """CASE WHEN contains({b}, '_') THEN 'snake_case' WHEN contains({b}, '-') THEN 'kebab-case'
  WHEN regexp_matches({b}, '[A-Z]') AND regexp_matches({b}, '[a-z]') THEN 'camelCase' WHEN {b} = upper({b}) THEN 'UPPERCASE'
  WHEN {b} = lower({b}) THEN 'lowercase' ELSE 'mixed' END"""


@query(f"WITH {VARIANTS} SELECT page_id, k, {_NAMING.format(b='base')} AS naming FROM x")
def path_naming(spark, sf_dir):
    return variants(spark, sf_dir).select("page_id", "k", P.naming(P.base_name("p")).alias("naming"))


@query(f"""WITH {VARIANTS} SELECT page_id, k, CASE WHEN p LIKE 'http://%' OR p LIKE 'https://%' OR p LIKE 'ftp://%' THEN 'url'
  WHEN p LIKE '/%' OR regexp_matches(p, '^[A-Za-z]:[\\\\/]') THEN 'absolute' WHEN contains(p, '/') OR contains(p, '\\') THEN 'relative'
  WHEN contains(p, '.') AND p NOT LIKE '%.' THEN 'file' ELSE 'unknown' END AS path_type FROM x""")
def path_detect_type(spark, sf_dir):
    return variants(spark, sf_dir).select("page_id", "k", classify.detect("p").alias("path_type"))


@query(f"""WITH {VARIANTS} SELECT page_id, k, NOT regexp_matches(p, '[<>:"|?*]') AND NOT regexp_matches(p, '(?i)(^|[/\\\\])(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])([/\\\\]|$)') AS valid,
  p LIKE '/%' OR regexp_matches(p, '^[A-Za-z]:[\\\\/]') AS absolute,
  NOT (p LIKE '/%' OR regexp_matches(p, '^[A-Za-z]:[\\\\/]')) AND regexp_matches(p, '[/\\\\]') AS relative, ext <> '' AS file,
  regexp_matches(p, '[/\\\\]$') OR (ext = '' AND regexp_matches(p, '[/\\\\]')) AS directory,
  NOT (contains(p, '..') OR contains(p, '~') OR p LIKE '/etc/%' OR p LIKE '/sys/%' OR starts_with(p, 'C:\\Windows\\')) AS safe FROM x""")
def path_predicates(spark, sf_dir):
    return variants(spark, sf_dir).select(
        "page_id", "k", Q.is_valid_path("p").alias("valid"), Q.is_absolute_path("p").alias("absolute"), Q.is_relative_path("p").alias("relative"),
        Q.is_file_path("p").alias("file"), Q.is_directory_path("p").alias("directory"), Q.is_path_safe("p").alias("safe"),
    )


_X = "[^\\s\"''<>|*?]"
_L = "[^\"''<>|*?]"


@query(f"""WITH {VARIANTS} SELECT page_id, k,
  regexp_matches(p, '^(/{_X}+|[A-Za-z]:\\\\{_X}+|\\.\\.?/{_X}+|https?://{_X}+|file://{_X}+|{_X}+\\.[a-zA-Z0-9]+|{_X}+/{_X}+)$') AS strict,
  regexp_matches(p, '^(/{_L}+|[A-Za-z]:\\\\{_L}+|\\.\\.?/{_L}+|https?://{_L}+|file://{_L}+|{_L}+\\.[a-zA-Z0-9]+|{_L}+/{_L}+)$') AS spaced,
  regexp_matches(p, '^(/{_L}+|[A-Za-z]:\\\\{_L}+|\\.\\.?/{_L}+|https?://{_X}+|file://{_X}+|[^\\s\"''<>|*?/\\\\]{{3,}}\\.[a-zA-Z]{{2,}})$') AS tree,
  regexp_matches(p, '^(\\./|\\.\\./|/|[A-Za-z]:[/\\\\]|https?://|file://)') AS module FROM x""")
def path_likeness(spark, sf_dir):
    return variants(spark, sf_dir).select(
        "page_id", "k", Q.is_path_strict("p").alias("strict"), Q.is_path_spaced("p").alias("spaced"), Q.is_path_json("p").alias("tree"),
        Q.is_module_path("p").alias("module"),
    )


@query(f"""WITH {VARIANTS}, j AS (SELECT page_id, k, CASE WHEN p LIKE '/%' OR regexp_matches(p, '^[A-Za-z]:[\\\\/]') THEN p ELSE '/srv/site/' || p END AS q FROM x),
  q AS (SELECT page_id, k, regexp_replace(replace(q, '\\', '/'), '/+', '/', 'g') AS q FROM j)
  SELECT page_id, k, CASE WHEN length(q) > 1 AND q LIKE '%/' THEN left(q, length(q) - 1) ELSE q END AS resolved FROM q""")
def path_resolve(spark, sf_dir):
    return variants(spark, sf_dir).select("page_id", "k", P.resolve(F.lit("/srv/site/index.html"), "p").alias("resolved"))


_BAD = """[CASE WHEN regexp_matches(p, '[<>:"|?*]') THEN 'Path contains invalid characters' END,
  CASE WHEN len(res) > 0 THEN 'Path contains reserved names: ' || array_to_string(res, ', ') END,
  CASE WHEN contains(p, '..') THEN 'Path contains traversal sequences (..)' END,
  CASE WHEN length(p) > 260 THEN 'Path exceeds maximum length (260 characters)' END]"""
_CHECKED = f"""{VARIANTS}, r AS (SELECT page_id, k, p, list_filter(regexp_split_to_array(p, '[/\\\\]'), lambda z: regexp_matches(z, '(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$')) AS res FROM x),
  w AS (SELECT page_id, k, p, array_to_string(list_filter({_BAD}, lambda z: z IS NOT NULL), ', ') AS wrong FROM r)"""


@query(f"WITH {_CHECKED} SELECT page_id, k, wrong AS errors FROM w")
def path_format_errors(spark, sf_dir):
    return variants(spark, sf_dir).select("page_id", "k", F.array_join(validate.format_errors("p"), ", ").alias("errors"))


@query(f"""WITH {_CHECKED} SELECT page_id, k, CASE WHEN wrong <> '' OR k = 5 AND page_id % 3 <> 0 OR k NOT IN (5) THEN 'invalid' ELSE 'valid' END AS status,
  CASE WHEN wrong <> '' THEN wrong WHEN k = 5 AND page_id % 3 = 0 THEN NULL ELSE 'File not found: ' || p END AS error FROM w""")
def validate_against_inventory(spark, sf_dir):
    entries = read(spark, sf_dir, "pages").filter("page_id % 3 = 0").select(text("src/page", F.col("page_id")).alias("path"))
    checked = validate.validate_paths(variants(spark, sf_dir), entries, value="p")
    return checked.select("page_id", "k", "status", "error")


@query(f"""WITH {_CHECKED} SELECT count(*) FILTER (WHERE wrong = '') AS valid, count(*) FILTER (WHERE wrong <> '') AS invalid,
  CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS inaccessible FROM w""")
def validation_rollup(spark, sf_dir):
    return validate.rollup(validate.validate_paths(variants(spark, sf_dir), value="p"))


# printf rounds a decimal tie to even; the displays round it up, so a tie gets a little more.
_TIE = "CASE WHEN {n} % {step} = {half} THEN 0.001 ELSE 0 END"
_SHORT = "regexp_replace(regexp_replace(printf('%.2f', {x}), '0+$', ''), '\\.$', '')"


def _bytes_case() -> str:
    cases = ["WHEN {n} = 0 THEN '0 Bytes' WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' Bytes'"]
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        size = 1024**i
        number = f"{{n}} / {size}.0 + " + _TIE.replace("{step}", str(size // 4)).replace("{half}", str(size // 8))
        cases.append(f"WHEN {{n}} < {1024 * size} OR {i} = 4 THEN {_SHORT.replace('{x}', number)} || ' {unit}'")
    return "CASE " + " ".join(cases) + " END"


def _time(size: int, step: int) -> str:
    return f"printf('%.2f', {{n}} / {size}.0 + " + _TIE.replace("{step}", str(step)).replace("{half}", str(step // 2)) + ")"


BYTES = _bytes_case()
DURATION = f"""CASE WHEN {{n}} < 1000 THEN CAST({{n}} AS VARCHAR) || 'ms' WHEN {{n}} < 60000 THEN {_time(1000, 250)} || 's'
    WHEN {{n}} < 3600000 THEN {_time(60_000, 15_000)} || 'm' ELSE {_time(3_600_000, 900_000)} || 'h' END"""
AGO = "CASE " + " ".join(
    f"WHEN {{s}} >= {size} THEN CAST({{s}} // {size} AS VARCHAR) || CASE WHEN {{s}} // {size} = 1 THEN ' {unit} ago' ELSE ' {unit}s ago' END"
    for size, unit in ((86_400, "day"), (3_600, "hour"), (60, "minute"), (1, "second"))
) + " ELSE 'just now' END"


@query(f"""SELECT page_id, {BYTES.format(n="page_id")} AS bytes, {DURATION.format(n="(page_id * 37)")} AS duration, {AGO.format(s="(page_id * 60)")} AS ago,
  printf('%.2f', page_id / 8.0 * 100) || '%' AS share, 'URL: ' || url AS label FROM pages""")
def format_functions(spark, sf_dir):
    n = F.col("page_id")
    return read(spark, sf_dir, "pages").select(
        n, formats.number_of_bytes(n).alias("bytes"), formats.duration(n * 37).alias("duration"),
        formats.relative_time(F.lit(0), n * 60_000).alias("ago"), formats.percentage(n / 8.0).alias("share"), formats.path("url").alias("label"),
    )


# ------------------------------------------------------------ post-processing


@query(f"WITH {HTML_CTE} SELECT doc_id, min(ordinal) AS ordinal, value FROM html GROUP BY doc_id, value")
def dedupe_first(spark, sf_dir):
    return engine.extract_documents(pages(spark, sf_dir), dedupe=True).paths.select("doc_id", "ordinal", "value")


def _sorted(mode: str, keys: str) -> None:
    def run(spark, sf_dir):
        docs = engine.extract_documents(pages(spark, sf_dir)).documents.select("doc_id", F.explode_outer(post.ranked_in_array("paths", mode)).alias("_each"))
        return docs.filter("_each is not null").select("doc_id", "_each.ordinal", "_each.path.value", "_each.rank")

    run.__name__ = "sort_" + mode.replace("-", "_")
    query(f"WITH {HTML_CTE} SELECT doc_id, ordinal, value, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {keys}, ordinal) AS INTEGER) AS rank FROM html")(run)


_sorted("alpha-asc", "icu_sort_key(value, 'en')")
_sorted("alpha-desc", "icu_sort_key(value, 'en') DESC")
_sorted("length-asc", "length(value)")
_sorted("length-desc", "length(value) DESC")


@query("""SELECT doc_id, CAST(len(l) AS INTEGER) AS total, CAST(len(list_distinct(list_filter(l, lambda x: x <> ''))) AS INTEGER) AS kept,
  CAST(len(l) - len(list_distinct(list_filter(l, lambda x: x <> ''))) AS INTEGER) AS removed
  FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM documents)""")
def dedupe_counts(spark, sf_dir):
    return post.removed_counts(read(spark, sf_dir, "documents"), "text")


# ------------------------------------------------------------------- profiling

_NORM = "CASE WHEN length(q) > 1 AND q LIKE '%/' THEN left(q, length(q) - 1) ELSE q END"
_PROFILE = f"""{HTML_CTE}, q AS (SELECT value, ordinal, doc_id, regexp_replace(replace(value, '\\', '/'), '/+', '/', 'g') AS q FROM html),
  w AS (SELECT *, {_NORM} AS norm, regexp_extract({_NORM}, '([^/]*)$', 1) AS file FROM q)"""


@query(f"""WITH {_PROFILE}, g AS (SELECT regexp_replace(norm, '[a-zA-Z0-9]', 'X', 'g') AS pattern, count(*) AS count FROM w GROUP BY 1)
  SELECT pattern, count, round(count * 100.0 / (SELECT sum(count) FROM g), 6) AS percentage FROM g""")
def profile_patterns(spark, sf_dir):
    found = profile.patterns(html(spark, sf_dir))
    return found.select("pattern", "count", F.round("percentage", 6).alias("percentage"))


@query(f"""WITH {_PROFILE}, r AS (SELECT regexp_replace(norm, '[a-zA-Z0-9]', 'X', 'g') AS pattern, value, doc_id,
    row_number() OVER (PARTITION BY doc_id, regexp_replace(norm, '[a-zA-Z0-9]', 'X', 'g') ORDER BY ordinal) AS r FROM w)
  SELECT doc_id, pattern, array_to_string(list(value ORDER BY r) FILTER (WHERE r <= 3), chr(10)) AS examples FROM r GROUP BY doc_id, pattern""")
def profile_examples(spark, sf_dir):
    found = profile.patterns(html(spark, sf_dir), by=("doc_id",))
    return found.select("doc_id", "pattern", F.array_join("examples", "\n").alias("examples"))


@query(f"""WITH {_PROFILE} SELECT CAST(len(list_filter(string_split(norm, '/'), lambda z: z <> '')) AS INTEGER) AS depth, count(*) AS count FROM w GROUP BY 1""")
def profile_depth(spark, sf_dir):
    return profile.depths(html(spark, sf_dir))


@query(f"""WITH {_PROFILE}, b AS (SELECT CASE WHEN contains(file, '.') THEN regexp_replace(file, '\\.[^.]*$', '') ELSE file END AS b FROM w)
  SELECT {_NAMING.format(b="b")} AS naming, count(*) AS count FROM b GROUP BY 1""")
def profile_naming(spark, sf_dir):
    return profile.namings(html(spark, sf_dir))


@query(f"""WITH {_PROFILE} SELECT lower(regexp_extract(file, '\\.([^.]*)$', 1)) AS extension, count(*) AS count FROM w
  WHERE contains(file, '.') AND regexp_extract(file, '\\.([^.]*)$', 1) <> '' GROUP BY 1""")
def profile_extensions(spark, sf_dir):
    return profile.extensions(html(spark, sf_dir))


# ------------------------------------------------------- resolution and validity


def _site(spark, sf_dir):
    """Paths of pages in three nested workspace folders."""
    k, folder = F.col("page_id"), F.element_at(F.array(F.lit("/m"), F.lit("/m/p"), F.lit("/m/p1"), F.lit("/m/p12")), (F.col("page_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", text(folder, "/page", k).alias("at"), text("./a/../b/", k, "//c.html").alias("value"))


def _folders(spark):
    return spark.createDataFrame([(0, "root", "/m", "file"), (1, "p", "/m/p", "file"), (2, "p1", "/m/p1", "file")], "folder_index int, name string, fs_path string, scheme string")


_FOLDER = "CASE page_id % 4 WHEN 1 THEN '/m/p' WHEN 2 THEN '/m/p1' ELSE '/m' END"


@query(f"SELECT page_id, {_FOLDER} AS folder FROM pages")
def workspace_folder(spark, sf_dir):
    return resolve.containing_folder(_site(spark, sf_dir), _folders(spark), "at").select("page_id", "folder")


@query(f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/real/' || page_id ELSE {_FOLDER} || '/b/' || page_id || '/c.html' END AS resolved FROM pages""")
def resolve_workspace(spark, sf_dir):
    site = resolve.containing_folder(_site(spark, sf_dir), _folders(spark), "at")
    linked = site.filter("page_id % 5 = 0").select(text(F.col("folder"), "/b/", F.col("page_id"), "/c.html").alias("path"), text("/real/", F.col("page_id")).alias("real_path"))
    return resolve.resolve_paths(site, folder="folder", entries=linked).select("page_id", "resolved")


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def broken_refs(spark, sf_dir):
    site = resolve.resolve_paths(resolve.containing_folder(_site(spark, sf_dir), _folders(spark), "at"), folder="folder")
    entries = site.filter("page_id % 3 = 0").select(F.col("resolved").alias("path"))
    return validate.broken_references(site, entries).select("page_id")


# ---------------------------------------------------------- admission, settings


@query("""SELECT doc_id, length(text) <= 5000 AS proceed, CASE WHEN length(text) > 5000 THEN 'Safety threshold exceeded: File size (' || length(text) || ' bytes) exceeds safety threshold (5000 bytes)'
    WHEN len(string_split(text, chr(10))) > 20 THEN 'Safety checks passed with 1 warnings' ELSE 'Safety checks passed' END AS message,
  CASE WHEN length(text) <= 5000 AND len(string_split(text, chr(10))) > 20 THEN 'Large file detected: ' || len(string_split(text, chr(10))) || ' lines (threshold: 20)' ELSE '' END AS warnings
  FROM documents""")
def safety_admission(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", admission.admission("text", max_units=5000, max_lines=20).alias("a"))
    return rows.select("doc_id", "a.proceed", "a.message", F.array_join("a.warnings", "\n").alias("warnings"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '/[^\\s"''<>|*?]+')) + len(regexp_extract_all(html, '[A-Za-z]:\\\\[^\\s"''<>|*?]+'))
    + len(regexp_extract_all(html, '\\.\\.?/[^\\s"''<>|*?]+')) + len(list_filter(regexp_extract_all(html, '["''][^"'']*["'']'), lambda q: contains(q, '/') OR contains(q, '\\'))) AS INTEGER) AS estimate,
  CAST(len(regexp_extract_all(html, '\\{[^{}]*\\{[^{}]*\\}[^{}]*\\}')) + len(regexp_extract_all(html, '\\[[^\\[\\]]*\\[[^\\[\\]]*\\][^\\[\\]]*\\]'))
    + len(regexp_extract_all(html, '/[^/\\n]+/[gimuy]*')) + len(regexp_extract_all(html, '`[^`]*\\$\\{[^}]*\\}[^`]*`')) AS INTEGER) AS complex FROM pages""")
def safety_estimates(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", admission.estimated_paths("html").alias("estimate"), admission.complex_patterns("html").alias("complex"))


@query("""SELECT r_regionkey AS doc_id, r_regionkey = 0 AS valid, CASE r_regionkey WHEN 0 THEN ''
  WHEN 1 THEN 'Unknown setting: "nope"|Setting "safety.enabled": Expected boolean, got number'
  WHEN 2 THEN 'Setting "performance.maxDuration": Value 5 is below minimum 1000|Setting "notificationsLevel": Value "loud" not in allowed values: all, important, silent'
  WHEN 3 THEN 'Settings must be a plain JSON object' ELSE 'Dangerous setting key rejected: "constructor"' END AS errors FROM region""")
def settings_validation(spark, sf_dir):
    texts = (
        '{"dedupeEnabled": true, "safety.fileSizeWarnBytes": 2000}', '{"nope": 1, "safety.enabled": 1}',
        '{"performance.maxDuration": 5, "notificationsLevel": "loud"}', "[]", '{"constructor": {}}',
    )
    content = F.element_at(F.array(*map(F.lit, texts)), (F.col("r_regionkey") + 1).cast("int"))
    docs = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), content.alias("content"))
    return settings.validate_settings(docs).select("doc_id", "valid", F.array_join("errors", "|").alias("errors"))


@query("""WITH t(i, type, n_extensions, n_languages, first_extension) AS (VALUES (0, 'json', 1, 1, '.json'), (1, 'yaml', 2, 2, '.yaml'), (2, 'javascript', 3, 1, '.js'),
  (3, 'typescript', 4, 2, '.ts'), (4, 'log', 2, 2, '.log'), (5, 'ini', 3, 1, '.ini'), (6, 'csv', 1, 1, '.csv'), (7, 'toml', 1, 1, '.toml'), (8, 'dotenv', 3, 2, '.env'))
SELECT CAST(p_partkey AS BIGINT) AS part, type, CAST(n_extensions AS INTEGER) AS n_extensions, CAST(n_languages AS INTEGER) AS n_languages, first_extension
FROM part LEFT JOIN t ON i = p_partkey % 11""")
def file_type_registry(spark, sf_dir):
    """The registry's entry of each part's type of file, some of which it does not know."""
    kinds = F.array(*map(F.lit, ("json", "yaml", "javascript", "typescript", "log", "ini", "csv", "toml", "dotenv", "html", "css")))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("part"), F.element_at(kinds, (F.col("p_partkey") % 11 + 1).cast("int")).alias("_kind"))
    found = parts.join(F.broadcast(sources.file_types(spark)), F.col("_kind") == F.col("type"), "left")  # nine rows
    return found.select("part", "type", F.size("extensions").alias("n_extensions"), F.size("language_ids").alias("n_languages"), F.get("extensions", F.lit(0)).alias("first_extension"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.local' WHEN 2 THEN '' WHEN 3 THEN '.gz' ELSE '' END AS extension,
  CASE page_id % 5 WHEN 0 THEN 'javascript' END AS registered, CASE page_id % 5 WHEN 0 THEN 'javascript' WHEN 1 THEN 'dotenv' WHEN 2 THEN 'dotenv' ELSE 'unknown' END AS language
  FROM pages""")
def file_type_lookup(spark, sf_dir):
    names = F.array(F.lit("A.min.JS"), F.lit(".env.local"), F.lit(".env"), F.lit("b.tar.gz"), F.lit("README"))
    rows = read(spark, sf_dir, "pages").select("page_id", F.element_at(names, (F.col("page_id") % 5 + 1).cast("int")).alias("name"))
    return rows.select("page_id", sources.file_extension("name").alias("extension"), sources.type_of_extension("name").alias("registered"), sources.language_of_file("name").alias("language"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'parsing' WHEN 1 THEN 'file-system' WHEN 2 THEN 'validation' WHEN 3 THEN 'safety' ELSE 'operational' END AS category,
  CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' WHEN 3 THEN 'info' ELSE 'critical' END AS severity,
  CASE event_id % 5 WHEN 0 THEN 'skip' WHEN 1 THEN 'retry' WHEN 2 THEN 'skip' WHEN 3 THEN 'fallback' ELSE 'abort' END AS action,
  CASE event_id % 5 WHEN 0 THEN 'Syntax error at key=***' WHEN 1 THEN 'Permission denied: /home/***/x' WHEN 2 THEN 'invalid token=***' WHEN 3 THEN 'threshold reached' ELSE 'fatal' END AS masked
  FROM events""")
def error_mapping(spark, sf_dir):
    found = F.array(*map(F.lit, ("Syntax error at key: abc", "Permission denied: /home/me/x", "invalid token=xyz", "threshold reached", "fatal")))
    rows = read(spark, sf_dir, "events").select("event_id", F.element_at(found, (F.col("event_id") % 5 + 1).cast("int")).alias("m"))
    rows = rows.withColumn("category", errors.categorize("m")).withColumn("severity", errors.severity("m", "category"))
    return rows.select("event_id", "category", "severity", errors.recovery_action("category", "severity").alias("action"), P.sanitize_message("m").alias("masked"))


@query("""SELECT event_id, event_id % 4 = 0 AS passed, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Duration 6.00s exceeds threshold 5.00s'
  WHEN 2 THEN 'Memory usage 200 MB exceeds threshold 100 MB|Throughput 500 items/s below threshold 1.0K items/s' ELSE 'Duration 12.00s exceeds threshold 5.00s' END AS warnings,
  CASE event_id % 4 WHEN 3 THEN 'Severe performance degradation: 12.00s' ELSE '' END AS errors FROM events""")
def metric_thresholds(spark, sf_dir):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(
        "event_id", pick(100, 6000, 100, 12000).alias("duration"), pick(1, 1, 209_715_200, 1).alias("memory_usage"), F.lit(1).alias("cpu_usage"),
        pick(5000, 5000, 500, 5000).alias("throughput"),
    )
    checked = metrics.check_thresholds(rows)
    messages = F.array_join(F.transform("warnings", lambda w: w["message"]), "|")
    return checked.select("event_id", "passed", messages.alias("warnings"), F.array_join("errors", "|").alias("errors"))


@query("""SELECT count(*) AS operations, avg(event_id % 100) AS avg_duration, avg(event_id % 7) AS avg_memory_usage, avg(event_id % 11) AS avg_throughput FROM events""")
def metric_report(spark, sf_dir):
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select((k % 100).alias("duration"), (k % 7).alias("memory_usage"), (k % 11).alias("throughput"))
    return metrics.report(rows)
