"""Import graphs of documents, and the cycles in them, by joins.

Strongly connected components come from trimming and from colouring forwards and backwards.
What nothing leads to, or what leads to nothing, is in no cycle and goes first. Then every node takes
the node of the smallest hash among those that lead to it; a node that keeps its own heads a component,
which is all of its colour that leads back to it. Components found go, and the rest begins anew; as
hashes are in no order, a row of components that lead to one another takes about as many turns as the
logarithm of its length. A node that very many import is no hot group: minima combine before they shuffle.
Joins of rounds are sort-merge joins: a broadcast would pass every round's table through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import directory, posix_resolve
from ..plans.engine import extract_documents
from ..sources.sinks import settled

#: What an import may leave out of a file's name, in the order of trial.
ENDINGS = ("", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".json", "/index.js", "/index.ts")
#: Steps of a round; more of them are fewer jobs and larger plans.
_STEPS = 3


def import_edges(docs: DataFrame, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(src, dst), distinct: documents (doc_id, uri, language_id, content) that refer to one another, by uri.

    Relative paths start at the document's folder. A path finds the document of that name or, failing it,
    with the first of ``endings`` that there is. Addresses, packages and what is not among the documents lead nowhere.
    """
    found = extract_documents(docs, keep=("uri",)).placed.filter(F.col("path_type").isin("relative", "absolute", "file"))
    at = posix_resolve(directory("uri"), F.col("value"))
    wanted = found.select(F.col("uri").alias("src"), at.alias("_at")).filter("src is not null").distinct()
    tried = wanted.select("src", "_at", F.posexplode(F.array(*(F.concat("_at", F.lit(e)) for e in endings))).alias("_nth", "_name"))
    known = docs.select(F.col("uri").alias("_name")).filter("_name is not null").distinct()
    return tried.join(known.hint("merge"), "_name").groupBy("src", "_at").agg(F.min(F.struct("_nth", "_name"))["_name"].alias("dst")).select("src", "dst").distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has one that leads to it and whose target has one that leads on."""
    reached, leading = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(reached.hint("merge"), "src", "left_semi").join(leading.hint("merge"), "dst", "left_semi").select("src", "dst")


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): of a node and all that lead to it, the one of the smallest hash, as (hash, node)."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colours = nodes.select("node", F.struct(F.xxhash64("node").alias("hash"), F.col("node").alias("node")).alias("colour"), F.lit(True).alias("new"))
    while True:
        for _ in range(_STEPS):
            sent = edges.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("theirs")).hint("merge"), "src")
            least = sent.groupBy(F.col("dst").alias("node")).agg(F.min("theirs").alias("least"))
            colours = colours.join(least.hint("merge"), "node", "left").select("node", F.least("colour", "least").alias("colour"), F.coalesce(F.col("least") < F.col("colour"), F.lit(False)).alias("new"))
        colours = settled(colours)
        if not colours.filter("new").limit(1).count():
            return colours.select("node", "colour")


def _heads_back(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lead back to their colour's head."""
    of = lambda name: colours.select(F.col("node").alias(name), F.col("colour").alias(f"{name}_colour")).hint("merge")
    inner = settled(edges.join(of("src"), "src").join(of("dst"), "dst").filter("src_colour = dst_colour").select("src", "dst"))
    marked = colours.filter("node = colour.node").select("node", F.col("node").alias("component"))
    count = marked.count()
    while True:
        for _ in range(_STEPS):
            back = inner.join(marked.select(F.col("node").alias("dst"), "component").hint("merge"), "dst").select(F.col("src").alias("node"), "component")
            marked = marked.union(back).distinct()
        marked = settled(marked)
        if (now := marked.count()) == count:
            return marked
        count = now


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of every node of (src, dst) that lies on a cycle; component is its smallest node.

    A node with an edge to itself is a cycle of one. Rows with a null end are no edges;
    repeated rows are one. No edges, or none on a cycle, give no rows. Every round is a few jobs, and rounds
    grow with the longest way inside what trimming leaves, not with the number of nodes.
    """
    edges = settled(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    alone = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    live, count, found = settled(edges.filter("src <> dst")), None, []
    while True:
        while (now := live.count()) and now != count:
            count = now
            live = settled(reduce(lambda e, _: _trimmed(e), range(_STEPS), live))
        if not now:
            break
        done = settled(_heads_back(live, _coloured(live)))
        found.append(done)
        gone = done.select("node")
        live = settled(live.join(gone.withColumnRenamed("node", "src").hint("merge"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_anti"))
        count = None
    every = reduce(DataFrame.unionByName, found, alone.filter("false"))
    sizes = every.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("_least"))
    several = every.join(sizes.hint("merge"), "component").filter("size > 1").select("node", F.col("_least").alias("component"), "size")
    single = alone.join(several.select("node").hint("merge"), "node", "left_anti").select("node", "component", F.lit(1).cast("long").alias("size"))
    return several.unionByName(single)


def import_cycles(docs: DataFrame, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(node, component, size) of the documents that import one another in circles."""
    return strong_components(import_edges(docs, endings))
