"""Near-duplicate vectors by an exact metric range join: pivots partition, the triangle inequality replicates, cells join alone."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteselect.llm.common import keep, map_arrow
from siteselect.llm.components import connected

#: Vectors in a packed block; a pair of blocks is what a task compares at a time.
BLOCK_ROWS = 2048
#: Most pivots of a group. More vectors than BLOCK_ROWS for each of them make larger cells, which are compared in more blocks: nothing is left out.
MAX_PIVOTS = 512
#: Candidates for a pivot; the ones near an earlier pivot are passed over, so that a large family of near copies gets one.
CANDIDATES = 4
#: Bounds give way by this much, far more than doubles can err by; cosines this close to the threshold are added up exactly.
SLACK = 1e-9

_GROUP = ["grp", "dims"]
_CORE, _HOME, _GUEST = 0, 1, 2


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite, not all of them zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, dims)


def _scaled(points: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is from 0.5 to 1: squares neither overflow nor vanish, and nothing is rounded."""
    return np.ldexp(points, -np.frexp(np.abs(points).max(axis=-1, keepdims=True))[1])


def _units(points: np.ndarray) -> np.ndarray:
    points = _scaled(points)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine from products of doubles and exactly rounded sums of them."""
    x, y = _scaled(x), _scaled(y)
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def _pack(extra: list[str]):
    """Of a group's rows (..., key, copies, x): one row with their keys and numbers packed."""

    def run(table: pa.Table) -> pa.Table:
        row = {c: table.column(c)[:1] for c in extra}
        row["keys"] = pa.array([b"".join(table.column("key").to_pylist())], pa.binary())
        row["copies"] = pa.array([table.column("copies").to_numpy().astype(np.int64).tobytes()], pa.binary())
        row["points"] = pa.array([b"".join(table.column("x").to_pylist())], pa.binary())
        return pa.table(row)

    return run


def _vectors_as_bytes(rows: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """`x`, an array of numbers, becomes the bytes of its doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.asarray(v, np.float64).tobytes() for v in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.binary())], [*columns, "x"])

    return map_arrow(rows.select(*columns, F.col("x").cast("array<double>").alias("x")), run, schema)


def _pivots(reach: float):
    """Of a group's candidates: those further than reach from each pivot before, up to the number wanted."""

    def run(table: pa.Table) -> pa.Table:
        dims, wanted = table.column("dims")[0].as_py(), table.column("wanted")[0].as_py()
        order = np.argsort(np.array(table.column("key").to_pylist(), dtype=object))
        units = _units(_matrix(b"".join(table.column("x").to_pylist()), dims))[order]
        chosen = units[:1]
        for unit in units[1:]:
            if len(chosen) == wanted:
                break
            if _distances(unit[None], chosen).min() > reach:
                chosen = np.concatenate([chosen, unit[None]])
        return pa.table({"grp": table.column("grp")[:1], "dims": table.column("dims")[:1], "pivots": pa.array([chosen.tobytes()], pa.binary())})

    return run


def _assigned(packs: DataFrame, reach: float, kind: str) -> DataFrame:
    """(grp, dims, cell, kind, key, copies, x): each vector in the cell of its nearest pivot, and as a guest in each that one of its neighbours may be in.

    If y is within reach of an x of cell j, then d(y, pj) <= d(x, pj) + reach <= d(x, pi) + reach <= d(y, pi) + 2 * reach for y's own pivot i; and y
    is within reach of the plane between the two. Vectors within half of reach of their pivot are the cell's core: all of them are neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, dims, keys, copies, points, pivots in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                x, n = _matrix(points, dims), len(keys) // 16
                if pivots is None:
                    row, cell, role = np.arange(n), np.zeros(n, np.int32), np.full(n, _HOME, np.int32)
                else:
                    centres = _matrix(pivots, dims)
                    d, apart = _distances(_units(x), centres), _distances(centres, centres)
                    home = d.argmin(axis=1)
                    own = d[np.arange(n), home][:, None]
                    met = (d <= own + 2 * reach + SLACK) & (d * d - own * own <= 2 * reach * apart[home] + SLACK)
                    met[np.arange(n), home] = True
                    row, cell = np.nonzero(met)
                    role = np.where(cell != home[row], _GUEST, np.where(own[row, 0] <= reach / 2 - SLACK, _CORE, _HOME))
                times = np.frombuffer(copies, np.int64)
                for at in range(0, len(row), 4096):
                    r = row[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([grp] * len(r), batch.schema.field(0).type),
                            pa.array([dims] * len(r), pa.int32()),
                            pa.array(cell[at : at + 4096].astype(np.int32)),
                            pa.array(role[at : at + 4096].astype(np.int32)),
                            pa.array([keys[16 * i : 16 * i + 16] for i in r.tolist()], pa.binary()),
                            pa.array(times[r]),
                            pa.array([points[8 * dims * i : 8 * dims * (i + 1)] for i in r.tolist()], pa.binary()),
                        ],
                        ["grp", "dims", "cell", "role", "key", "copies", "x"],
                    )

    return map_arrow(packs.select("grp", "dims", "keys", "copies", "points", "pivots"), run, f"grp {kind}, dims int, cell int, role int, key binary, copies long, x binary")


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x have a cosine of threshold or more with which of y."""
    cosines = _units(x) @ _units(y).T
    found = cosines >= threshold
    for i, j in np.argwhere(np.abs(cosines - threshold) <= SLACK).tolist():
        found[i, j] = cosine(x[i], y[j]) >= threshold
    return found


def _roots(left: np.ndarray, right: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest left row that each left and right row is connected with by the links (left, right)."""
    low, high = np.arange(n), np.full(m, n)
    while True:
        np.minimum.at(high, right, low[left])
        after = low.copy()
        np.minimum.at(after, left, high[right])
        after = np.minimum(after, after[after])
        if (after == low).all():
            return low, high
        low = after


def _compared(tiles: DataFrame, threshold: float) -> DataFrame:
    """(key, n, root): a row of the left block with the copies in the right block that it links with; and rows of either with the key of one they are connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, keys, points, their_keys, copies, their_points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = np.frombuffer(keys, "V16")
                others = np.frombuffer(their_keys, "V16")
                found = linked(_matrix(points, dims), _matrix(their_points, dims), threshold)
                left, right = np.nonzero(found)
                apart = names[left] != others[right]
                left, right = left[apart], right[apart]
                if not len(left):
                    continue
                counts = np.zeros(len(names), np.int64)
                np.add.at(counts, left, np.frombuffer(copies, np.int64)[right])
                low, high = _roots(left, right, len(names), len(others))
                rows, theirs = np.unique(left), np.unique(right)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([bytes(k) for k in names[rows]] + [bytes(k) for k in others[theirs]], pa.binary()),
                        pa.array(np.concatenate([counts[rows], np.zeros(len(theirs), np.int64)])),
                        pa.array([bytes(k) for k in names[low[rows]]] + [bytes(k) for k in names[high[theirs]]], pa.binary()),
                    ],
                    ["key", "n", "root"],
                )

    return map_arrow(tiles, run, "key binary, n long, root binary")


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """(key, n, root) for classes (grp, dims, key, copies, x binary): copies of other classes linked with, and classes that one is connected with; keys repeat."""
    reach, kind = math.sqrt(2 - 2 * threshold), classes.schema["grp"].dataType.simpleString()
    groups = classes.groupBy(*_GROUP).agg(F.count("*").alias("size"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    groups = keep(groups.withColumn("wanted", F.least("blocks", F.lit(MAX_PIVOTS))), "range-groups")
    named = classes.join(groups, _GROUP)
    slots = F.pmod(F.xxhash64(F.lit("pivot"), "key"), F.lit(1 << 30)) / (1 << 30)
    drawn = named.where((F.col("wanted") > 1) & (slots < CANDIDATES * F.col("wanted") / F.col("size")))
    pivots = drawn.select(*_GROUP, "key", "x", "wanted").groupBy(*_GROUP).applyInArrow(_pivots(reach), f"grp {kind}, dims int, pivots binary")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    packed = "keys binary, copies binary, points binary"
    packs = named.select(*_GROUP, block.alias("block"), "key", "copies", "x").groupBy(*_GROUP, "block").applyInArrow(_pack([*_GROUP, "block"]), f"grp {kind}, dims int, block int, {packed}")
    rows = keep(_assigned(packs.join(pivots, _GROUP, "left"), reach, kind), "range-rows")
    cell = [*_GROUP, "cell"]
    blocks_of = lambda role: F.ceil(F.count_if(F.col("role") == role) / BLOCK_ROWS).cast("int")
    cells = rows.groupBy(*cell).agg(
        *(blocks_of(r).alias(f"b{r}") for r in (_CORE, _HOME, _GUEST)),
        F.sum(F.when(F.col("role") == _CORE, F.col("copies"))).alias("core"),
        F.min(F.when(F.col("role") == _CORE, F.col("key"))).alias("root"),
    )
    cells = keep(cells, "range-cells")
    dealt = rows.join(cells, cell).withColumn("block", F.pmod(F.xxhash64("key"), F.element_at(F.array("b0", "b1", "b2"), F.col("role") + 1)).cast("int"))
    held = dealt.select(*cell, "role", "block", "b0", "b1", "key", "copies", "x").groupBy(*cell, "role", "block")
    blocks = keep(held.applyInArrow(_pack([*cell, "role", "block", "b0", "b1"]), f"grp {kind}, dims int, cell int, role int, block int, b0 int, b1 int, {packed}"), "range-blocks")
    left = blocks.where(F.col("role") != _GUEST).select(*cell, (F.col("block") + F.when(F.col("role") == _HOME, F.col("b0")).otherwise(0)).alias("slot"), F.col("keys").alias("own"), F.col("points").alias("own_points"))
    first, last = F.when(F.col("role") == _CORE, F.col("b0")).otherwise(0), F.col("b0") + F.col("b1") - 1
    right = blocks.where(first <= last).withColumn("slot", F.explode(F.sequence(first, last)))
    found = _compared(left.join(right, [*cell, "slot"]).select("dims", "own", "own_points", "keys", "copies", "points"), threshold)
    core = rows.where(F.col("role") == _CORE).join(cells, cell).select("key", (F.col("core") - F.col("copies")).alias("n"), "root")
    return found.unionByName(core)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """(id, n_links, component, kept) for each row: the other vectors of its group at a cosine of threshold or more, the smallest id reachable by such links,
    its own included, and whether that is its own.

    Vectors of equal groups and lengths are compared. Those that are null, empty or all zero, hold a null or non-finite component or have no group link with
    nothing; they and vectors without neighbours have their own id as component. Repeated rows are vectors of their own and link with one another. A null id
    counts among the links; a component of null ids alone is null, and its rows are not kept. Other columns are not looked at.

    Equal vectors form a class, named by 128 bits of hashes, and meet in one aggregate. Classes are packed into blocks; those of groups with more than BLOCK_ROWS
    go to the cells of pivots. A cell's core needs no comparisons, however large a family of near copies it is; of all else a task compares two blocks at a time
    and returns counts and a spanning set of links, never pairs. Where all vectors of a group are far from each other compared with the threshold's distance, as random
    ones in many dimensions are, each visits every cell and the comparisons grow with the square of the group; nothing exact avoids that.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    key = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), "grp", "x")), 16, "0") for seed in (1, 2)]))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.transform(vector_col, lambda c: c.cast("double") + 0.0).alias("x"))
    rows = rows.withColumn("key", F.when(F.col("grp").isNotNull() & usable(F.col("x")), key)).withColumn("dims", F.size("x"))
    kind = rows.schema["grp"].dataType.simpleString()
    ids = rows.select("id", "key")
    usable_rows = _vectors_as_bytes(rows.where("key is not null"), [*_GROUP, "key", "id"], f"grp {kind}, dims int, key binary, id {rows.schema['id'].dataType.simpleString()}, x binary")
    classes = usable_rows.groupBy(*_GROUP, "key").agg(F.count("*").alias("copies"), F.min("id").alias("low"), F.first("x").alias("x"))
    classes = keep(classes, "range-classes")
    found = keep(_links(classes.drop("low"), threshold), "range-links")
    rooted = connected(found.select("key", "root"), "key", "root").withColumnsRenamed({"node": "key", "component": "root"})
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    known = classes.select("key", "copies", "low").join(counts, "key", "left").join(rooted, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component"))
    known = keep(known.join(lowest, "root").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"), "range-classes")
    joined = ids.where("key is not null").join(known, "key").select("id", "n_links", "component")
    alone = ids.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))


ORACLE = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.93),
reached(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reached GROUP BY vec_id"""
