"""Paths of JSON documents without Python, where their order does not matter: profiles, counts, joins.

Texts become VARIANT values, whose containers are exploded level by level. Each level is
kept as a checkpoint of the strings found and the containers still to open, so that a level is
worked out once and a job a level is run, as many as the deepest document has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.predicates import is_path_json
from ..functions.text import NOT_SPACE, column, let
from ..sources.sinks import settled

#: Closes the object in which a text is parsed, so that what follows a value makes it invalid.
_END = "\\u0001end of document"
_HIGH, _LOW, _HEX = "\\\\u[dD][89abAB][0-9a-fA-F]{2}", "\\\\u[dD][c-fC-F][0-9a-fA-F]{2}", "(?<!\\\\)((?:\\\\\\\\)*)"


def parsed(content: Column | str) -> Column:
    """The VARIANT of a JSON text: null for null, blank and invalid texts.

    Spark's parser ignores what follows the first value, so the text is parsed as a member of an object whose
    last member is known. Half characters in escapes become U+FFFD. Of repeated keys the last counts
    (see ``json_paths``). Texts beyond Spark's limits on VARIANT's size or depth are invalid.
    """
    text = column(content)
    lone = F.regexp_replace(F.regexp_replace(text, f"{_HEX}{_HIGH}(?!{_LOW})", "$1\\\\ufffd"), f"(?<!{_HIGH}){_LOW}", "\\\\ufffd")
    text = F.when(text.rlike("\\\\u[dD][89a-fA-F]"), lone).otherwise(text)
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(f',"{_END}":1}}')))

    def member(w: Column) -> Column:
        sound = F.size(F.map_keys(F.try_variant_get(w, "$", "map<string, variant>"))) == 2
        ended = F.try_variant_get(w, "$['\x01end of document']", "int") == 1
        return F.when(sound & ended, F.variant_get(w, "$.v", "variant"))

    return F.when(column(content).rlike(NOT_SPACE), let(whole, member))


def _opened(node: Column) -> Column:
    """struct(_open, _value) of a VARIANT: itself if it is a container, its text if that is path-like; null for all others."""
    container = F.struct(node.alias("_open"), F.lit(None).cast("string").alias("_value"))
    found = lambda v: F.when(is_path_json(v), F.struct(F.lit(None).cast("variant").alias("_open"), v.alias("_value")))

    def of_kind(kind: Column) -> Column:
        opens = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
        return F.when(opens, container).when(kind == "STRING", let(F.try_variant_get(node, "$", "string"), found))

    return let(F.schema_of_variant(node), of_kind)


def json_paths(docs: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, value, path_type, context) of the path-like strings of JSON documents, in no order; no Python runs.

    The rows are those of ``extract_tree`` without ordinal, line and column. What cannot be parsed has no
    paths. The session is set to accept repeated keys in VARIANT values, the last of which counts.
    """
    docs.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    kept = [f"`{c}`" for c in keep]
    rows = docs.select(*kept, F.lit(None).cast("string").alias("_at"), parsed(content).alias("_node"))
    levels: list[DataFrame] = []
    tvf = docs.sparkSession.tvf
    while True:
        # An outer explode of at most one struct: a filter on it stays behind it, and each node is looked at once.
        # (A filter on the node itself would be pushed below the caller's shuffles, and parse twice.)
        rows = rows.select(*kept, "_at", F.explode_outer(F.array(_opened(F.col("_node")))).alias("_seen")).filter("_seen is not null")
        rows = settled(rows.select(*kept, "_at", "_seen.*"))
        levels.append(rows.filter("_value is not null").select(*kept, F.col("_value").alias("value"), F.coalesce("_at", F.lit("value")).alias("_at")))
        rows = rows.filter("_open is not null")
        if not rows.limit(1).count():
            break
        step = F.coalesce(F.col("_key"), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        rows = rows.lateralJoin(tvf.variant_explode(F.col("_open").outer()).toDF("_pos", "_key", "_node"))
        rows = rows.select(*kept, F.when(F.col("_at").isNull(), step).otherwise(F.concat("_at", F.lit("."), step)).alias("_at"), "_node")
    every = reduce(DataFrame.unionByName, levels)
    return every.select(*kept, "value", classify.generic("value").alias("path_type"), F.concat(F.lit("JSON "), "_at").alias("context"))
