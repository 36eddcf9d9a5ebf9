"""Queries of operators that work in rounds, on pieces of files or on streams, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cycles, links, runs, variants
from ..streaming import extract as streams
from ..sources import pieces, sinks
from .detail_queries import _carried
from . import engine
from .queries import HTML_CTE, _LANGS, _event_tree, _mixed, dealt, pages, query, read, text

# ------------------------------------------------------------------------ links

#: Chains of twelve links, every fifth of which bites its tail; a link on a folder that leads to a
#: chain, a relative link below a chain's end; every seventh chain ends in a link without target.
_LINKS = """k AS (SELECT p_partkey AS k, p_partkey // 13 AS g, p_partkey % 13 AS n FROM part), g AS (SELECT DISTINCT g FROM k),
l(path, target) AS (
  SELECT '/l/g' || g || '/n' || n, CASE WHEN n = 11 AND g % 5 = 0 THEN 'n3' WHEN n = 11 AND g % 7 = 1 THEN NULL ELSE 'n' || (n + 1) END FROM k WHERE n < 12
  UNION ALL SELECT '/w/d' || g, '/l/g' || g || '/n0' FROM g
  UNION ALL SELECT '/l/g' || g || '/n12/inner', '../../../s/x' || g FROM g
), p AS (
  SELECT k AS path_id, CASE k % 3 WHEN 0 THEN '/w/d' || g || '/inner/file' || k || '.txt' WHEN 1 THEN '/l/g' || g || '/n' || n || '/a/b' || k ELSE '/plain/' || k END AS value FROM k
)"""


def _linked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    keys = read(spark, sf_dir, "part").select(k.alias("k"), F.floor(k / 13).alias("g"), (k % 13).alias("n"))
    k, g, n = (F.col(c) for c in "kgn")
    onward = F.when((n == 11) & (g % 5 == 0), "n3").when((n == 11) & (g % 7 == 1), F.lit(None)).otherwise(text("n", n + 1))
    groups = keys.select("g").distinct()
    inventory = keys.filter(n < 12).select(text("/l/g", g, "/n", n).alias("path"), onward.alias("target"))
    inventory = inventory.union(groups.select(text("/w/d", g), text("/l/g", g, "/n0"))).union(groups.select(text("/l/g", g, "/n12/inner"), text("../../../s/x", g)))
    value = F.when(k % 3 == 0, text("/w/d", g, "/inner/file", k, ".txt")).when(k % 3 == 1, text("/l/g", g, "/n", n, "/a/b", k)).otherwise(text("/plain/", k))
    return keys.select(k.cast("long").alias("path_id"), value.alias("value")), inventory


_FOLLOW = f"""{_LINKS}, t AS (
  SELECT path, CASE WHEN target IS NULL THEN NULL WHEN target LIKE '../../../%' THEN target[9:] WHEN target LIKE '/%' THEN target
    ELSE regexp_replace(path, '[^/]*$', '') || target END AS target FROM l
), walk AS (
  SELECT path_id, value, value AS here, 0 AS follows, false AS lost FROM p
  UNION ALL
  SELECT w.path_id, w.value, t.target || w.here[length(t.path) + 1:], w.follows + 1, t.target IS NULL OR w.follows >= 40
  FROM walk w, (SELECT unnest(range(1, 12)) AS depth) d, t
  WHERE NOT w.lost AND len(string_split(w.here, '/')) >= d.depth AND t.path = array_to_string(string_split(w.here, '/')[1:d.depth], '/')
)"""


@query(f"""WITH RECURSIVE {_FOLLOW}, last AS (SELECT path_id, value, arg_max(here, follows) AS here, max(follows) AS follows, bool_or(lost) AS lost FROM walk GROUP BY path_id, value)
SELECT CAST(path_id AS BIGINT) AS path_id, CASE WHEN lost THEN value ELSE here END AS resolved, CAST(follows AS INTEGER) AS follows, lost AS fallback FROM last""")
def link_chains(spark, sf_dir):
    paths, inventory = _linked(spark, sf_dir)
    return links.canonical_links(paths, inventory).select("path_id", "resolved", "follows", "fallback")


# --------------------------------------------------------------- files in pieces


def _in_files(rows: DataFrame, key: str, tag: str, ending: str) -> str:
    """Texts written as four files, by the key modulo 4 and in its order, whose names end in ``ending``."""
    spark = rows.sparkSession
    path = sinks.scratch(spark, tag)
    dealt = rows.withColumn("f", F.col(key) % 4).repartition(4, "f").sortWithinPartitions("f", key)
    dealt.select("f", "text").write.partitionBy("f").text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(hadoop(f"{path}/f=*/part-*")):  # four names
        files.rename(found.getPath(), hadoop(found.getPath().toString().removesuffix(".txt") + ending))
    return path


def _file_numbers(spark, path: str) -> DataFrame:
    return pieces.scan_lines(spark, path).select("doc_id", F.regexp_extract("uri", "/f=(\\d)/", 1).cast("int").alias("f")).distinct()


@query("""WITH r AS (SELECT p_partkey AS k, CAST(p_partkey % 4 AS INTEGER) AS f, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1 AS n FROM part), o AS (SELECT unnest([0, 1]) AS o)
SELECT f, CAST(2 * n + o AS INTEGER) AS ordinal, CASE o WHEN 0 THEN './p' || k || '.css' ELSE 'img' || k || '.png' END AS value, CASE o WHEN 0 THEN 'relative' ELSE 'file' END AS path_type,
  CAST(3 * n + 1 + o AS INTEGER) AS line, CAST(1 + 19 * o AS INTEGER) AS "column", CASE o WHEN 0 THEN 'CSS @import' ELSE 'CSS url()' END AS context FROM r, o""")
def line_pieces(spark, sf_dir):
    """Style files of very many lines, each read by as many tasks as it has splits."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(k.alias("k"), text("@import './p", k, ".css';\n", "\u00e9 .x { background: url( img", k, ".png ) }\n").alias("text"))
    path = _in_files(rows, "k", "line-pieces", ".css")
    return pieces.extract_lines(spark, path).join(F.broadcast(_file_numbers(spark, path)), "doc_id").drop("doc_id")


@query("""WITH r AS (SELECT s_suppkey AS k, CAST(s_suppkey % 4 AS INTEGER) AS f, row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey) - 1 AS n FROM supplier), o AS (SELECT unnest([0, 1, 2, 3]) AS o)
SELECT f, CAST(4 * n + o AS INTEGER) AS ordinal, CASE o WHEN 0 THEN './s' || k || '/a.csv' WHEN 1 THEN '/abs/' || k WHEN 2 THEN '/in/' || k ELSE 'x' || k || '.y' END AS value,
  CAST(2 * n + 1 + o // 2 AS INTEGER) AS line, CASE o WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS "column" FROM r, o""")
def csv_pieces(spark, sf_dir):
    """CSV files with cells over several lines, each read by as many tasks as it has splits."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(k.alias("k"), text("./s", k, '/a.csv,"over\nlines ""', k, '""",/abs/', k, '\n\n"\n/in/', k, '\n",x', k, ".y").alias("text"))
    path = _in_files(rows, "k", "csv-pieces", ".csv")
    found = pieces.extract_csv_files(spark, path).join(F.broadcast(_file_numbers(spark, path)), "doc_id")
    return found.select("f", "ordinal", "value", "line", "column")


# ----------------------------------------------------------------------- streams


@query(f"""SELECT CAST(r_regionkey * 100 + i AS BIGINT) AS doc_id, l NOT IN ('yaml', 'ini') AS success, CAST(CASE WHEN l IN ('yaml', 'ini') THEN 0 ELSE 1 END AS BIGINT) AS n_paths,
  CASE WHEN l IN ('yaml', 'ini') THEN 'format' END AS category FROM region, {_LANGS}
  UNION ALL SELECT CAST(100000 + n_nationkey * 10 + i AS BIGINT), i = 0, CASE i WHEN 0 THEN 3 ELSE 0 END, CASE i WHEN 1 THEN 'parsing' WHEN 2 THEN 'format' END
  FROM nation, (SELECT unnest([0, 1, 2]) AS i)""")
def stream_mixed(spark, sf_dir):
    """Documents of all formats as a stream of files, with their errors, to the end of what is there."""
    docs = _mixed(spark, sf_dir).unionByName(_carried(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 100_000))
    path = sinks.scratch(spark, "stream-mixed")
    docs.repartition(3).write.parquet(f"{path}/in")
    found = streams.stream_documents(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")).documents
    run = found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    back = spark.read.schema(found.schema).parquet(f"{path}/out")
    return back.select("doc_id", "success", F.size("paths").cast("long").alias("n_paths"), F.col("error.category").alias("category"))


@query("""SELECT CAST(n_nationkey % 5 AS VARCHAR) AS source, count(*) * 3 AS documents, count(*) * 3 AS paths, count(*) * 2 AS failed, count(*) * 3 AS relative FROM nation GROUP BY 1""")
def stream_profiles(spark, sf_dir):
    """Running profiles of sources over a stream that ends and, with more files, begins again from its state."""
    docs = _carried(spark, sf_dir).withColumn("source", F.floor(F.col("doc_id") / 10) % 5)
    path = sinks.scratch(spark, "stream-profiles")
    for part in range(2):
        docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part).repartition(2).write.mode("append").parquet(f"{path}/in")
        found = streams.running_profiles(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"))
        run = found.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(
            lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/out")
        )
        run.trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(f"{path}/out")
    last = seen.groupBy("source").agg(F.max_by(F.struct("documents", "paths", "failed", F.col("by_type")["relative"].alias("relative")), "batch").alias("p"))
    return last.select("source", "p.*")


# ------------------------------------------------------------------ JSON, no order

_TREE = """(SELECT event_id AS doc_id, 'one' || event_id || '.txt' AS value, 'file' AS path_type, 'JSON 1.[0]' AS context FROM events
  UNION ALL SELECT event_id, '/two' || event_id, 'absolute', 'JSON 2' FROM events UNION ALL SELECT event_id, './x' || event_id, 'relative', 'JSON b' FROM events
  UNION ALL SELECT event_id, '../last' || event_id, 'relative', 'JSON d' FROM events)"""


@query(f"SELECT * FROM {_TREE}")
def json_any_order(spark, sf_dir):
    return variants.json_paths(_event_tree(spark, sf_dir))


@query(f"SELECT path_type, context, count(*) AS count, count(DISTINCT value) AS distinct_values FROM {_TREE} GROUP BY ALL")
def json_type_counts(spark, sf_dir):
    return json_any_order(spark, sf_dir).groupBy("path_type", "context").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("value").alias("distinct_values"))


# -------------------------------------------------------------- runs, observed


@query(f"""WITH {HTML_CTE}, n AS (SELECT (SELECT count(*) FROM pages) AS documents, (SELECT count(*) FROM html) AS paths, (SELECT coalesce(sum(strlen(html)), 0) FROM pages) AS size)
SELECT CAST(documents AS BIGINT) AS documents, CAST(paths AS BIGINT) AS paths, CAST(0 AS BIGINT) AS failed, CAST(size AS BIGINT) AS bytes, true AS timed FROM n""")
def observed_run(spark, sf_dir):
    """What an extraction wrote, as observed while it wrote it."""
    docs = pages(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long"))
    path = sinks.scratch(spark, "observed")
    found = engine.extract_documents(docs, keep=("size",)).documents
    run = runs.within(spark, lambda: runs.measured(found, lambda rows: rows.write.parquet(path), size="size"), seconds=3600, writes=path)
    seen = run.table(spark).select("documents", "paths", "failed", F.lit(run.bytes).cast("long").alias("bytes"), (F.col("duration") > 0).alias("timed"))
    return seen


# ----------------------------------------------------------------- import cycles


@query("""WITH RECURSIVE k AS (SELECT p_partkey // 10 AS g, p_partkey % 10 AS n FROM part), names AS (SELECT '/m/g' || g || '/f' || n || '.js' AS uri FROM k),
t AS (
  SELECT g, n, g AS tg, (n + 1) % 4 AS tn FROM k WHERE n < 4 UNION ALL SELECT g, n, g, 4 FROM k WHERE n = 1 UNION ALL SELECT g, n, g, 1 FROM k WHERE n = 4
  UNION ALL SELECT g, n, g, 5 FROM k WHERE n = 5 UNION ALL SELECT g, n, g, 7 FROM k WHERE n = 6 UNION ALL SELECT g, n, g, 0 FROM k WHERE n = 7
  UNION ALL SELECT g, n, g, 8 FROM k WHERE n = 3 AND g % 4 <> 3 UNION ALL SELECT g, n, g + 1, 0 FROM k WHERE n = 8
), e AS (SELECT DISTINCT '/m/g' || g || '/f' || n || '.js' AS a, '/m/g' || tg || '/f' || tn || '.js' AS b FROM t WHERE '/m/g' || tg || '/f' || tn || '.js' IN (SELECT uri FROM names)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT x.a AS node, least(min(x.b), x.a) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def import_cycles(spark, sf_dir):
    """Modules with circles of imports, one inside another, one of a module with itself, and ways between them."""
    k = F.col("p_partkey")
    keys = dealt(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    rows = keys.select(F.floor(k / 10).alias("g"), (k % 10).alias("n"), k.cast("long").alias("doc_id"))
    g, n = F.col("g"), F.col("n")
    content = (
        F.when(n == 1, "import a from './f2.js'\nconst b = require('./f4')").when(n == 3, F.when(g % 4 != 3, "import a from './f0'\nexport * from './f8.js'").otherwise("import a from './f0'"))
        .when(n < 4, text("import a from './f", n + 1, "'")).when(n == 4, "import('./f1.js')").when(n == 5, "import './f5.js'").when(n == 6, "require('../x/.././g/f7'); require('./f7.js')")
        .when(n == 7, text("import a from '../g", g, "/f0.js'")).when(n == 8, text("import a from '/m/g", g + 1, "/f0'")).otherwise("import r from 'react'\nimport m from './missing.js'")
    )
    docs = rows.select("doc_id", text("/m/g", g, "/f", n, ".js").alias("uri"), F.lit("javascript").alias("language_id"), content.alias("content"))
    return cycles.import_cycles(docs)
