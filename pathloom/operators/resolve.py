"""Canonical paths: workspace folders and symbolic links by joins with inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalize, posix_resolve, resolve
from ..functions.predicates import is_absolute_path
from ..functions.text import trim
from .links import canonical_links

#: Workspace roots up to which they are compared with every path; beyond, prefixes are joined.
_FEW_FOLDERS = 1000


#: Rows of an inventory up to which it is sent to all tasks.
_FEW_ENTRIES = 200_000


def small_to_all(table: DataFrame) -> DataFrame:
    """A table of strings, marked for broadcast if a count shows that it is small; else joins split hot keys at run time."""
    return F.broadcast(table) if table.limit(_FEW_ENTRIES + 1).count() <= _FEW_ENTRIES else table


def is_virtual(folders: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, virtual), without ``by`` one row: whether any folder is not on a file system."""
    return folders.groupBy(*by).agg(F.coalesce(F.bool_or(F.col("scheme") != "file"), F.lit(False)).alias("virtual"))


def _prefixes(path: Column) -> Column:
    """A path and all its parents, down to the root."""
    parts = F.split(path, "/", -1)
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.transform(whole, lambda p: F.when(p == "", "/").otherwise(p))


def containing_folder(paths: DataFrame, folders: DataFrame, value: str = "value") -> DataFrame:
    """Adds folder: the longest workspace folder that contains the path, null if none does.

    One folder contains everything. A folder ends at a separator. A broadcast of
    checked size serves few folders; many are met by a join on the path's parents.
    """
    roots = folders.select(F.regexp_replace("fs_path", "(?<=.)/+\\z", "").alias("_root")).distinct()
    n = roots.limit(_FEW_FOLDERS + 1).count()
    if n == 0:
        return paths.withColumn("folder", F.lit(None).cast("string"))
    if n == 1:
        return paths.crossJoin(F.broadcast(roots.withColumnRenamed("_root", "folder")))  # one row
    v = F.col(value)
    if n <= _FEW_FOLDERS:
        listed = F.broadcast(roots.agg(F.collect_list("_root").alias("_roots")))  # one row of at most _FEW_FOLDERS names
        inside = lambda r: (v == r) | v.startswith(F.when(r == "/", "/").otherwise(F.concat(r, F.lit("/"))))
        best = F.array_sort(F.transform(F.filter("_roots", inside), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))
        return paths.crossJoin(listed).withColumn("folder", F.try_element_at(best, F.lit(-1))["r"]).drop("_roots")
    keyed = paths.select(v.alias("_v")).distinct().withColumn("_parent", F.explode(_prefixes(F.col("_v"))))
    found = keyed.join(roots, F.col("_parent") == F.col("_root")).groupBy("_v").agg(F.max_by("_root", F.length("_root")).alias("folder"))
    return paths.join(found, v == F.col("_v"), "left").drop("_v")


def resolve_paths(
    paths: DataFrame, *, value: str = "value", folder: str | None = None, entries: DataFrame | None = None, virtual: bool = False,
    workspace_relative: bool = True, symlinks: bool = True, compat_urls: bool = False,
) -> DataFrame:
    """Adds resolved: the normalised path, from its workspace folder, with links followed.

    ``folder``: a column with the workspace folder. ``entries`` (path, real_path):
    the link inventory; what is not in it stays. Blank paths stay. With both flags
    off paths are only normalised. Addresses pass through unless ``compat_urls``,
    which treats them as relative paths.
    """
    v = F.col(value)
    plain = normalize(v)
    out = plain
    if workspace_relative and folder:
        out = F.when(F.col(folder).isNull() | plain.startswith("/"), plain).otherwise(posix_resolve(F.col(folder), plain))
    rows = paths.withColumn("_at", out)
    if symlinks and entries is not None and not virtual:
        real = entries.filter("real_path is not null").groupBy(F.col("path").alias("_path")).agg(F.min("real_path").alias("_real"))
        rows = rows.join(small_to_all(real), F.col("_at") == F.col("_path"), "left").withColumn("_at", F.coalesce("_real", "_at"))
    address = v.rlike("\\A[A-Za-z][A-Za-z0-9+.-]+://") & F.lit(not compat_urls)
    done = F.when(v.isNull() | (F.length(trim(v)) == 0) | address, v).otherwise(F.col("_at"))
    return rows.select(*paths.columns, done.alias("resolved"))


def resolve_enhanced(paths: DataFrame, base: str, value: str = "value", **options) -> DataFrame:
    """Adds resolved: first from the folder of the ``base`` file, then canonically."""
    first = paths.withColumn("_from", F.when(is_absolute_path(value), normalize(value)).otherwise(resolve(base, value)))
    return resolve_paths(first, value="_from", **options).drop("_from")


def resolve_monorepo(paths: DataFrame, folders: DataFrame, value: str = "value", given: str | None = None, **options) -> DataFrame:
    """Adds resolved: from the ``given`` folder of each path, else from the workspace folder that contains it, else from none."""
    found = containing_folder(paths, folders, value).withColumnRenamed("folder", "_found")
    own = F.coalesce(F.col(given), F.col("_found")) if given else F.col("_found")
    return resolve_paths(found.withColumn("_folder", own), value=value, folder="_folder", **options).drop("_found", "_folder")


def canonical(
    paths: DataFrame, *, folders: DataFrame | None = None, links: DataFrame | None = None, value: str = "value", at: str = "value",
    parents: bool = False, **options,
) -> DataFrame:
    """Adds resolved and fallback to extracted paths.

    ``folders``: workspace folders, found by the column ``at``. ``links`` (path,
    real_path): the link inventory. A path whose link has no known target keeps its
    value and is a fallback; no folders on a file system, no links are followed.
    ``parents``: links on the folders of a path are followed too, and links of links; what
    leads to a loop or to a link without target is a fallback. ``real_path`` is then where
    the link itself points, from its own folder if relative.
    """
    rows, kept = paths, paths.columns
    virtual = False
    if folders is not None:
        virtual = bool(is_virtual(folders).first()["virtual"])
        rows = containing_folder(rows, folders, at).withColumnRenamed("folder", "_folder")
    whole_paths = None if parents else links
    rows = resolve_paths(rows, value=value, folder="_folder" if folders is not None else None, entries=whole_paths, virtual=virtual, **options)
    fallback = F.lit(False)
    if parents and links is not None and not virtual:
        rows = canonical_links(rows.withColumnRenamed("resolved", "_plain"), links, "_plain", target="real_path")
        fallback = F.col("fallback")
    elif links is not None and not virtual:
        whole = links.groupBy(F.col("path").alias("_link")).agg(F.max("real_path").alias("_target")).filter("_target is null").select("_link")
        rows = rows.join(small_to_all(whole), F.col("resolved") == F.col("_link"), "left")
        fallback = F.col("_link").isNotNull()
    return rows.select(*kept, F.when(fallback, F.col(value)).otherwise(F.col("resolved")).alias("resolved"), fallback.alias("fallback"))


def resolution_counts(resolved: DataFrame, value: str = "value") -> DataFrame:
    """One row: paths, how many the resolution changed, and how many it left for want of a link's target."""
    fallback = F.count_if("fallback") if "fallback" in resolved.columns else F.lit(0).cast("long")
    return resolved.agg(F.count(F.lit(1)).alias("paths"), F.count_if(F.col("resolved") != F.col(value)).alias("changed"), fallback.alias("fallback"))
