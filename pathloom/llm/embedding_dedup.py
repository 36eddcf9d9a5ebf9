"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors become one class with a multiplicity. Classes are dealt into
blocks of similar ones, by the sides of some directions on which they lie; a block
holds its unit vectors as int8 codes with a scale each and the exact norm of what
quantisation lost, its centre, and the widest angle to it. Tasks take pairs of block
groups and multiply codes tile by tile; integer products are exact. With u = s*q + e, two
unit vectors' product differs from the codes' product by at most
|e_v| * (1 + |e_u|) + |e_u|, so pairs below threshold by more than that are surely
not linked; only the others are recomputed from the vectors in double precision.

A task returns sums of links and a spanning forest of the links it found, never
the pairs themselves. By the triangle inequality of angles no pair of two blocks, or
groups, can reach the threshold if their centres lie further apart than both widest
angles and the threshold's; such groups are not sent to one another and such tiles not
multiplied. All others are, so work and shuffled bytes grow with the square of the
number of distinct vectors where these have no clusters; rows and memory do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .components import connected_components, forest

_BLOCK = "block long, dim int, n long, keys binary, ids binary, mult binary, codes binary, scale binary, lost binary, vectors binary, centre binary, wide double"
#: Vectors from which directions are learned; bytes of all groups' centres up to which they are broadcast; slack of angles in radians.
_SAMPLE, _CENTRES, _SLACK = 4096, 64_000_000, 1e-6
#: Blocks up to which the table of their groups (a few numbers a row) is broadcast.
_FEW_BLOCKS = 1_000_000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, first by their largest component so that none underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their scales, and an upper bound of the norm of each row's error."""
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    lost = u - codes * scale[:, None]
    return codes, scale, np.sqrt((lost * lost).sum(axis=1)) * (1 + 1e-12) + 1e-15


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between the unit rows of two matrices."""
    return np.arccos(np.clip(a @ b.T, -1, 1))


def around(units: np.ndarray) -> tuple[np.ndarray, float]:
    """A unit centre of unit rows and the widest angle of a row to it."""
    centre = units.mean(axis=0)
    size = np.sqrt((centre * centre).sum())
    centre = centre / size if size > 1e-9 else units[0]
    return centre, float(angle(units, centre[None, :]).max()) + _SLACK


def directions(units: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to n main directions of a sample, and the middle of the sample along each."""
    if not len(units) or n < 1:
        return np.zeros((0, units.shape[1] if units.ndim == 2 else 0)), np.zeros(0)
    centred = units - units.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    main = vectors.T[::-1][:n]
    return main, np.median(units @ main.T, axis=0)


class Block:
    def __init__(self, row: dict) -> None:
        self.number, self.n, dim, self.group = row["block"], row["n"], row["dim"], row["group"]
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.keys, self.ids, self.mult = read("keys", "<i8"), read("ids", "<i8"), read("mult", "<i8")
        kind = np.float32 if dim * 127 * 127 < 2**24 else np.float64  # integers of this size are exact in it
        self.codes = read("codes", np.int8).reshape(self.n, dim).astype(kind)
        self.scale, self.lost = read("scale", "<f8"), read("lost", "<f8")
        self.units = unit(read("vectors", "<f8" if len(row["vectors"]) == 8 * self.n * dim else "<f4").reshape(self.n, dim))
        self.centre, self.wide = read("centre", "<f8"), row["wide"]
        self.links = np.zeros(self.n, dtype=np.int64)

    def apart(self, other: Block, threshold: float) -> bool:
        """Whether no vector of the one can be linked with one of the other."""
        return float(angle(self.centre[None, :], other.centre[None, :])[0, 0]) > self.wide + other.wide + np.arccos(threshold) + _SLACK


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """Products of the unit rows i of one matrix and j of another, or of all rows, pair by pair."""
    i, j = (np.arange(len(a)), np.arange(len(b))) if i is None else (i, j)
    parts = [np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0)


def tile(one: Block, two: Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in one, in two) of all linked pairs; in one block, each pair once."""
    product = one.codes @ two.codes.T
    most = one.lost.max() * (1 + two.lost.max()) + two.lost.max() + 1e-6
    product *= two.scale.astype(product.dtype)
    i, j = np.nonzero(product >= ((threshold - most) / one.scale).astype(product.dtype)[:, None])
    if one is two:
        i, j = i[i < j], j[i < j]
    bound = one.lost[i] * (1 + two.lost[j]) + two.lost[j] + 1e-6  # 1e-6: rounding of the scaled product
    near = product[i, j].astype(np.float64) * one.scale[i] + bound >= threshold
    i, j = i[near], j[near]
    if len(i) * 16 > one.n * two.n:
        exact = (one.units @ two.units.T)[i, j]
        close = np.flatnonzero(np.abs(exact - threshold) < 1e-9)  # the same sums decide here as below
        exact[close] = cosines(one.units[i[close]], two.units[j[close]])
    else:
        exact = cosines(one.units, two.units, i, j)
    return i[exact >= threshold], j[exact >= threshold]


def link_vectors(vectors: DataFrame, *, threshold: float = 0.95, block_rows: int = 1024, group_blocks: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, zero, empty or hold a null or non-finite component, and
    rows without vec_id, link with nothing. So do vectors of different lengths.
    Rows that share a vec_id are one node of the components, but each row counts as
    a vector in n_links. Other columns are ignored. An empty table gives no rows.
    """
    e = F.col("embedding")
    kind = "double" if "array<double>" in dict(vectors.dtypes)["embedding"] else "float"
    valid = (
        F.col("vec_id").isNotNull() & e.isNotNull()
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(e, lambda x: x != 0)
    )
    rows = vectors.select("vec_id", "embedding").withColumn("_valid", F.coalesce(valid, F.lit(False)))
    key1, key2 = F.xxhash64(F.lit(1), "embedding"), F.xxhash64(F.lit(2), "embedding")
    classes = rows.filter("_valid").groupBy(key1.alias("h1"), key2.alias("h2")).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding")
    )
    classes = materialize(classes, "vector-classes")
    blocks = max(1, -(-classes.count() // block_rows))

    def pack(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy().astype("<i8").tobytes()
        dim, n = table.column("dim")[0].as_py(), table.num_rows
        flat = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(n, dim)
        units = unit(flat)
        codes, scale, lost = quantise(units)
        centre, wide = around(units)
        values = [table.column("block")[0].as_py(), dim, n, column("h1"), column("rep"), column("mult"), codes.tobytes(), scale.tobytes(), lost.tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 8, pa.float64()]
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        flat = flat.astype("<f8" if kind == "double" else "<f4")
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip([*values, flat.tobytes(), centre.astype("<f8").tobytes(), wide], kinds, strict=True)], names=names)

    dealt = _dealt(classes.withColumn("dim", F.size("embedding")), blocks, block_rows)
    packed = materialize(dealt.groupBy("block", "dim").applyInArrow(pack, _BLOCK), "vector-blocks")
    # Neighbours in the order of blocks are alike and make a group.
    number = packed.select("block", "dim").distinct().withColumn("_order", F.row_number().over(Window.orderBy("dim", "block")) - 1)  # one row a block
    number = materialize(number, "vector-numbers")
    groups = max(1, -(-number.count() // group_blocks))
    numbered = number.select(F.col("block").alias("_b"), F.col("dim").alias("_d"), F.floor(F.col("_order") / group_blocks).cast("long").alias("group"))
    if groups * group_blocks <= _FEW_BLOCKS:
        numbered = F.broadcast(numbered)
    packed = packed.join(numbered, (F.col("block") == F.col("_b")) & (F.col("dim") == F.col("_d"))).drop("_b", "_d")
    reach = _partners(packed, groups, threshold)
    sent = packed.join(reach, "group").select(
        "*", F.least("group", "other").alias("one"), F.greatest("group", "other").alias("two")
    ).drop("other")

    def multiply(table: pa.Table) -> pa.Table:
        first, second = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        held = [Block(row) for row in table.drop_columns(["one", "two"]).to_pylist()]
        a_side = [b for b in held if b.group == first]
        b_side = [b for b in held if b.group == second]
        edges = []
        for one in a_side:
            for two in b_side:
                if one.codes.shape[1] != two.codes.shape[1] or (first == second and (one.number, id(one)) > (two.number, id(two))):
                    continue
                if one is not two and one.apart(two, threshold):
                    continue
                i, j = tile(one, two, threshold)
                if len(i):
                    one.links += np.bincount(i, weights=two.mult[j], minlength=one.n).astype(np.int64)
                    two.links += np.bincount(j, weights=one.mult[i], minlength=two.n).astype(np.int64)
                    edges.append(forest(one.ids[i], two.ids[j]))
        a, b = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, dtype=np.int64) for k in (0, 1))
        a, b = forest(a, b) if len(a) else (a, b)
        keys = np.concatenate([x.keys[x.links > 0] for x in held])
        links = np.concatenate([x.links[x.links > 0] for x in held])
        none = lambda n: pa.nulls(n, pa.int64())
        parts = [[pa.array(keys), pa.array(links), none(len(keys)), none(len(keys))], [none(len(a)), none(len(a)), pa.array(a), pa.array(b)]]
        names = ["h1", "links", "a", "b"]
        return pa.concat_tables([pa.Table.from_arrays(p, names=names).cast(pa.schema([(n, pa.int64()) for n in names])) for p in parts])

    found = materialize(sent.groupBy("one", "two").applyInArrow(multiply, "h1 long, links long, a long, b long"), "vector-links")
    parts = connected_components(found.filter("a is not null"))
    sums = found.filter("h1 is not null").groupBy("h1").agg(F.sum("links").alias("links"))
    known = classes.select("h1", "h2", "rep", "mult").join(sums, "h1", "left").join(parts, F.col("rep") == F.col("node"), "left").select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("_links"),
        F.coalesce("component", "rep").alias("_component"),
    )
    keyed = rows.select("vec_id", F.when(F.col("_valid"), key1).alias("_k1"), F.when(F.col("_valid"), key2).alias("_k2"))
    out = keyed.join(known, (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _dealt(classes: DataFrame, blocks: int, block_rows: int) -> DataFrame:
    """``classes`` with a block each: of similar vectors, about ``block_rows`` of them.

    Vectors of one length lie on two sides of each of some directions, learned from at
    most _SAMPLE of them; the sides make a cell, and a cell of many vectors is cut by hash.
    """
    bits = max(0, min(16, int(np.ceil(np.log2(max(1, blocks))))))
    share = F.lit(int(1_000_000 * min(1.0, _SAMPLE / max(1, blocks * block_rows))))
    sample = classes.filter(F.pmod(F.col("h1"), F.lit(1_000_000)) < F.greatest(share, F.lit(1))).orderBy("h1").limit(_SAMPLE).select("embedding").toArrow()
    by_dim: dict[int, list] = {}
    for row in sample.column("embedding").to_pylist():
        by_dim.setdefault(len(row), []).append(row)
    learned = {d: directions(unit(np.array(rows)), min(bits, d)) for d, rows in by_dim.items() if len(rows) > 1}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            lists, cell = batch.column(names.index("embedding")), np.zeros(batch.num_rows, dtype=np.int64)
            dims = batch.column(names.index("dim")).to_numpy()
            for d in np.unique(dims).tolist():
                if d in learned and len(learned[d][0]):
                    mine = np.flatnonzero(dims == d)
                    flat = lists.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), d)
                    main, middle = learned[d]
                    cell[mine] = ((unit(flat) @ main.T) > middle) @ (1 << np.arange(len(main))[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*names, "cell"])

    schema = ", ".join(f"{n} {t}" for n, t in classes.dtypes) + ", cell long"
    placed = materialize(map_batches(classes, cells, schema), "vector-cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("_parts"))  # at most 65,536 cells
    inside = F.pmod("h2", F.col("_parts"))
    return placed.join(F.broadcast(sizes), "cell").withColumn("block", F.shiftleft("cell", 40) + inside).drop("_parts", "cell")


def _partners(packed: DataFrame, groups: int, threshold: float) -> DataFrame:
    """(group, other): the groups whose blocks may hold links, each group with itself; both ways round."""
    rows = packed.select("group", "dim", "centre", "wide")

    def gather(table: pa.Table) -> pa.Table:
        """A group's centre among its blocks' centres, and the widest angle to what they hold."""
        dims = set(table.column("dim").to_pylist())
        centres = [np.frombuffer(c.as_py(), dtype="<f8") for c in table.column("centre")]
        group = table.column("group")[0].as_py()
        if len(dims) > 1:  # vectors of several lengths: no angle tells
            return pa.table({"group": [group], "dim": pa.array([-1], pa.int32()), "centre": pa.array([b""], pa.binary()), "wide": [np.pi]})
        each = np.stack(centres)
        centre, _ = around(each)
        wide = float((angle(each, centre[None, :])[:, 0] + table.column("wide").to_numpy()).max())
        return pa.table({"group": [group], "dim": pa.array([dims.pop()], pa.int32()), "centre": pa.array([centre.astype("<f8").tobytes()], pa.binary()), "wide": [wide]})

    known = materialize(rows.groupBy("group").applyInArrow(gather, "group long, dim int, centre binary, wide double"), "vector-groups")
    size = known.agg(F.coalesce(F.sum(F.octet_length("centre") + 32), F.lit(0)).alias("n")).first()["n"]
    if size > _CENTRES:  # too many centres for a broadcast: every group meets every other
        every = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))
        return known.select("group", F.explode(every).alias("other"))
    table = known.toArrow()
    all_ids, all_dims, all_wide = (table.column(c).to_numpy() for c in ("group", "dim", "wide"))
    by_dim = {}
    for d in np.unique(all_dims).tolist():
        at = np.flatnonzero(all_dims == d)
        by_dim[d] = (all_ids[at], all_wide[at], None if d < 0 else np.stack([np.frombuffer(table.column("centre")[i].as_py(), dtype="<f8") for i in at.tolist()]))
    shared = packed.sparkSession.sparkContext.broadcast(by_dim)
    reach = float(np.arccos(threshold)) + 2 * _SLACK

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            groups_here, others = [], []
            for group, dim, centre, wide in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for d, (ids, wides, centres) in held.items():
                    if dim < 0 or d < 0:
                        found = ids
                    elif d != dim:
                        continue
                    else:
                        found = ids[angle(centres, np.frombuffer(centre, dtype="<f8")[None, :])[:, 0] <= wides + wide + reach]
                    groups_here += [group] * len(found)
                    others += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(groups_here, pa.int64()), pa.array(others, pa.int64())], names=["group", "other"])

    return map_batches(known.select("group", "dim", "centre", "wide"), near, "group long, other long")
