"""Exact top-k search by inner product with KD-trees, one for each shard of the vectors."""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteselect.llm.common import keep, map_arrow, partitions

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 2048, 512, 128
#: Most cells, sampled rows for each of them, and most components of that sample: cells are a partition only, and their boxes go to every task.
CELLS, CELL_SAMPLE, SAMPLE_COMPONENTS = 1024, 16, 1 << 22
#: Cells for vectors of lengths that the sample has not got, or hardly.
SPARE = 64
#: Bytes of questions that are sent on at a time.
SENT_BYTES = 16 << 20


def quantised(vector: Column, factor: int = 256) -> Column:
    """Each component as floor(factor * x); null for vectors that are null, empty, or hold a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0)
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def _exact(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> type:
    """The type in which inner products of the queries with points of the boxes are exact: doubles multiply faster, up to 2^53."""
    side = max(float(np.abs(low).max(initial=1)), float(np.abs(high).max(initial=1)))
    return np.float64 if float(np.abs(queries).max(initial=1)) * side * queries.shape[1] < 2**53 else np.int64


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest inner product of each query with any point of each box."""
    kind = _exact(queries, low, high)
    asks = queries.astype(kind)
    return np.maximum(asks, 0) @ high.astype(kind).T + np.minimum(asks, 0) @ low.astype(kind).T


class Cells:
    """Splits along the widest side of a sample, for each length of vectors: near vectors share a cell, and each cell has a box.

    A split is at the median where both sides get as many cells, else in proportion to them.

    Cells of one length follow each other. Lengths with too few sampled rows for a cell share SPARE cells without boxes.
    """

    def __init__(self, sample: dict[int, np.ndarray], cells: int) -> None:
        total = sum(map(len, sample.values()))
        self.count, self.nodes, self.roots, self.spans = 0, [], {}, {}
        for dims, points in sorted(sample.items()):
            if share := min(cells * len(points) // total, max(1, len(points) // CELL_SAMPLE)):
                before = self.count
                self.roots[dims] = self._split(points, share)
                self.spans[dims] = (before, self.count)
        self.boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _split(self, points: np.ndarray, share: int) -> int:
        number = len(self.nodes)
        side = int(np.argmax(points.max(axis=0).astype(float) - points.min(axis=0)))
        values = np.sort(points[:, side])
        if share < 2 or values[0] == values[-1]:
            self.nodes.append((-1, self.count, -1, -1))
            self.count += 1
            return number
        cut = values[(len(values) - 1) * (share // 2) // share]
        if cut == values[-1]:
            cut = values[np.searchsorted(values, cut) - 1]
        self.nodes.append(())
        below = points[:, side] <= cut
        self.nodes[number] = (side, int(cut), self._split(points[below], share // 2), self._split(points[~below], share - share // 2))
        return number

    def assign(self, points: np.ndarray) -> np.ndarray:
        dims = points.shape[1]
        out = np.full(len(points), self.count + dims % SPARE, np.int32)
        waiting = [(self.roots[dims], np.arange(len(points)))] if dims in self.roots else []
        while waiting:
            number, rows = waiting.pop()
            side, value, left, right = self.nodes[number]
            if side < 0:
                out[rows] = value
                continue
            below = points[rows, side] <= value
            waiting += [(left, rows[below]), (right, rows[~below])]
        return out

    def reach(self, queries: np.ndarray, known: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each cell with the queries that it may improve: those without a k-th (score, id), and those whose bound in its box is not behind theirs."""
        dims = queries.shape[1]
        if dims not in self.boxes:
            yield self.count + dims % SPARE, np.arange(len(queries))
            return
        low, high, first = self.boxes[dims]
        bounds = _bounds(queries, low, high)
        may = ~known[:, None] | (bounds > scores[:, None]) | ((bounds == scores[:, None]) & (first[None, :] <= ids[:, None]))
        for number in np.flatnonzero(may.any(axis=0)).tolist():
            yield self.spans[dims][0] + number, np.flatnonzero(may[:, number])


class Tree:
    """Median splits along the widest side, down to leaves; each node has the tight box of its points and their smallest id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        order = np.lexsort((ids,))
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.first, self.nodes = [], [], [], []
        self._build(0, len(ids))
        self.low, self.high, self.first = np.array(self.low), np.array(self.high), np.array(self.first)
        self.nodes = np.array(self.nodes, dtype=np.int64).reshape(-1, 4)

    def _build(self, start: int, end: int) -> int:
        """The number of the node for rows start..end; nodes are (start, end, left, right), with left -1 in a leaf."""
        points = self.points[start:end]
        low, high = points.min(axis=0), points.max(axis=0)
        number = len(self.nodes)
        self.low.append(low)
        self.high.append(high)
        self.first.append(self.ids[start:end].min())
        self.nodes.append((start, end, -1, -1))
        side = int(np.argmax(high - low))
        if end - start > LEAF_ROWS and high[side] > low[side]:
            half = (end - start) // 2
            order = np.argsort(points[:, side], kind="stable")
            self.points[start:end], self.ids[start:end] = points[order], self.ids[start:end][order]
            left = self._build(start, start + half)
            right = self._build(start + half, end)
            self.nodes[number] = (start, end, left, right)
        return number

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, points=self.points, low=self.low, high=self.high, first=self.first, nodes=self.nodes)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as held:
            for name in held.files:
                setattr(tree, name, held[name])
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, limits: list[tuple[int, int] | None]) -> list[list[tuple[int, int]]]:
        """Up to k (score, id) of each query, best first; with a limit (score, id), only what comes before or at it.

        Nodes are visited by the highest inner product that their box allows; when that is below the k-th score so far, the rest is, too.
        """
        kind = _exact(queries, self.low, self.high)
        points, asks = self.points.astype(kind), queries.astype(kind)
        bounds = _bounds(queries, self.low, self.high)
        nodes, first = self.nodes.tolist(), self.first.tolist()
        answers = []
        for row, limit in enumerate(limits):
            best: list[tuple[int, int]] = []  # a heap of (score, -id)
            worst = limit
            bound = bounds[row].tolist()
            heap = [(-bound[0], 0)]
            while heap:
                top, number = heapq.heappop(heap)
                if worst is not None:
                    if -top < worst[0]:
                        break
                    if -top == worst[0] and first[number] > worst[1]:
                        continue
                start, end, left, right = nodes[number]
                if left >= 0:
                    heapq.heappush(heap, (-bound[left], left))
                    heapq.heappush(heap, (-bound[right], right))
                    continue
                scores = points[start:end] @ asks[row]
                ids = self.ids[start:end]
                fit = ids != own[row]
                if worst is not None:
                    fit &= (scores > worst[0]) | ((scores == worst[0]) & (ids <= worst[1]))
                for score, point in zip(scores[fit].tolist(), ids[fit].tolist(), strict=True):
                    item = (int(score), -point)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k and (worst is None or (best[0][0], -best[0][1]) != worst):
                    worst = (best[0][0], -best[0][1])
            answers.append([(s, -i) for s, i in sorted(best, reverse=True)])
        return answers


def _grow(group: pd.DataFrame) -> pd.DataFrame:
    tree = Tree(group["vec_id"].to_numpy(np.int64), np.stack(group["v"].to_numpy()).astype(np.int64))
    one = {name: [int(group[name].iloc[0])] for name in ("cell", "shard", "dims")}
    return pd.DataFrame({**one, "first": [int(tree.first[0])], "low": [tree.low[0]], "high": [tree.high[0]], "tree": [tree.dump()]})


def _gather(group: pd.DataFrame) -> pd.DataFrame:
    data = {"ids": group["vec_id"].to_numpy(np.int64).tobytes(), "points": np.stack(group["v"].to_numpy()).astype(np.int64).tobytes()}
    return pd.DataFrame({**{name: [int(group[name].iloc[0])] for name in ("cell", "block", "dims")}, **{name: [x] for name, x in data.items()}})


def _cells(points: DataFrame, rows: int) -> Cells:
    """Splits from a sample of at most CELLS * CELL_SAMPLE rows and SAMPLE_COMPONENTS components, whatever the number of rows."""
    widest = points.agg(F.max("dims")).first()[0] or 1
    size = max(1, min(CELLS * CELL_SAMPLE, SAMPLE_COMPONENTS // widest))
    drawn = points if rows <= size else points.sample(size / rows, seed=3).limit(2 * size)
    held: dict[int, list] = {}
    for row in drawn.select("v").collect():
        held.setdefault(len(row["v"]), []).append(row["v"])
    return Cells({dims: np.array(v, np.int64) for dims, v in held.items()}, max(1, min(CELLS, math.ceil(rows / SHARD_ROWS), size // CELL_SAMPLE)))


def _placed(rows: DataFrame, cells: Cells) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            values, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1].astype(np.int64)
            sizes, cell = batch.column("dims").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dims in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dims)
                cell[mine] = cells.assign(values[starts[mine][:, None] + np.arange(dims)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "v", "dims", "cell"])

    return map_arrow(rows.select("vec_id", "v", "dims"), run, "vec_id long, v array<long>, dims int, cell int")


def _parts(rows: DataFrame, size: int) -> DataFrame:
    """(cell, parts): in how many parts of about `size` rows each cell is cut; CELLS + SPARE rows at most."""
    counts = rows.groupBy("cell").agg(F.greatest(F.lit(1), F.round(F.count("*") / size)).cast("int").alias("parts"))
    return rows.sparkSession.createDataFrame(counts.collect(), "cell int, parts int")


def _boxed(cells: Cells, trees: DataFrame) -> None:
    """The tight box of each cell, from its shards' own, and its smallest id."""
    mine = trees.where(F.col("cell") < cells.count)
    sides = mine.select("dims", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("side", "x"))
    sides = sides.groupBy("dims", "cell", "side").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).toArrow()
    firsts = {r["cell"]: r["first"] for r in mine.groupBy("cell").agg(F.min("first").alias("first")).collect()}
    dims_, cell, side, low, high = (sides.column(c).to_numpy() for c in ("dims", "cell", "side", "low", "high"))
    for dims, (start, end) in cells.spans.items():
        rows = dims_ == dims
        lows, highs = np.zeros((end - start, dims), np.int64), np.zeros((end - start, dims), np.int64)
        lows[cell[rows] - start, side[rows]], highs[cell[rows] - start, side[rows]] = low[rows], high[rows]
        cells.boxes[dims] = (lows, highs, np.array([firsts[c] for c in range(start, end)], np.int64))


_LIMITED = ["ids", "points", "scores", "limits", "known"]


def _sent(blocks: DataFrame, cells: Cells) -> DataFrame:
    """(block, cell, dims, home, queries and their limits): a block's queries once for each cell that may improve them; home is the shard of that cell that they have asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "cell", "dims", "home", *_LIMITED]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        rows, size = [], 0
        for batch in batches:
            for block, home_cell, home, dims, ids, points, asked, scores, limits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, data = np.frombuffer(ids, np.int64), np.frombuffer(points, np.int64).reshape(-1, dims)
                order = np.argsort(own)
                worst, last, known = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), bool)
                if asked:
                    asks, found = np.frombuffer(asked, np.int64), np.frombuffer(scores, np.int64)
                    mine = np.isin(asks, own)
                    at = order[np.searchsorted(own, asks[mine], sorter=order)]
                    worst[at], last[at], known[at] = found[mine], np.frombuffer(limits, np.int64)[mine], True
                for cell, some in cells.reach(data, known, worst, last):
                    packed = [x[some].tobytes() for x in (own, data, worst, last, known)]
                    rows.append((block, cell, dims, home if cell == home_cell else -1, *packed))
                    size += len(packed[1])
                    if size >= SENT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    fields = ["block", "cell", "home", "dims", "ids", "points", "asked", "scores", "limits"]
    return map_arrow(blocks.select(*fields), run, "block long, cell int, dims int, home int, " + ", ".join(f"{c} binary" for c in _LIMITED))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, or all if there are fewer; ties go to smaller vec_id.

    Both inputs are (vec_id long, v array of long); rows with a null in either take no part, and a query meets the vectors of its own
    length alone. A query's own row is that of its vec_id. Of queries with one vec_id the smallest vector counts; repeated vectors are ranked as often as they occur.

    Splits of a bounded sample deal all vectors to cells; a cell of many rows is cut into shards of about SHARD_ROWS by a hash, and each
    shard grows its tree once. Queries of a cell form blocks of about BLOCK_ROWS. Every block first asks one shard of its own cell; the k-th score that
    a query finds there is held against the boxes of all cells, and the query goes on, with that score, only to those that can better it.
    """
    columns = (F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dims"))
    whole = "vec_id is not null and v is not null"
    points = keep(vectors.where(whole).select(*columns), "vectors")
    cells = _cells(points, points.count())
    placed = keep(_placed(points, cells), "placed")
    parts = _parts(placed, SHARD_ROWS)
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("shard", shard).groupBy("cell", "shard", "dims")
    trees = keep(dealt.applyInPandas(_grow, "cell int, shard int, dims int, first long, low array<long>, high array<long>, tree binary"), "trees")
    _boxed(cells, trees)

    asks = queries.where(whole).select(*columns).groupBy("vec_id").agg(F.min_by(F.struct("v", "dims"), "v").alias("x")).select("vec_id", "x.*")
    asks = keep(_placed(asks, cells), "queries")
    block = F.shiftleft(F.col("cell").cast("long"), 40) + F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.col("parts"))
    blocked = asks.join(F.broadcast(_parts(asks, BLOCK_ROWS)), "cell").withColumn("block", block).groupBy("cell", "block", "dims")
    gathered = blocked.applyInPandas(_gather, "cell int, block long, dims int, ids binary, points binary").join(F.broadcast(parts), "cell", "left")
    gathered = keep(gathered.withColumn("home", F.pmod("block", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            loaded, tree_ = b"", None
            for tree, dims, block_, ids, data, scores, limits, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(ids, np.int64)
                worst: list[tuple[int, int] | None] = [None] * len(own)
                if known:
                    pairs = zip(np.frombuffer(scores, np.int64).tolist(), np.frombuffer(limits, np.int64).tolist(), np.frombuffer(known, bool).tolist(), strict=True)
                    worst = [(s, i) if is_known else None for s, i, is_known in pairs]
                if tree != loaded:  # a join gives the blocks of one tree one after the other
                    loaded, tree_ = tree, Tree.load(tree)
                found = tree_.search(np.frombuffer(data, np.int64).reshape(-1, dims), own, k, worst)
                out += [(block_, q, point, score) for q, best in zip(own.tolist(), found, strict=True) for score, point in best]
            columns_ = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns_], ["block", "query_id", "vec_id", "score"])

    def limits_of(group: pd.DataFrame) -> pd.DataFrame:
        worst = group.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").nth(k - 1)
        packed = {name: [worst[column].to_numpy(np.int64).tobytes()] for name, column in (("asked", "query_id"), ("scores", "score"), ("limits", "vec_id"))}
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], **packed})

    result = "block long, query_id long, vec_id long, score long"
    asked = ["tree", "dims", "block", *_LIMITED]
    grown = trees.select("cell", "shard", "dims", "tree")
    none = {c: F.lit(b"") for c in ("scores", "limits", "known")}
    home = gathered.withColumnRenamed("home", "shard").join(grown, ["cell", "shard", "dims"]).withColumns(none)
    first = keep(map_arrow(home.select(*asked).repartition(partitions(home)), run, result), "first-shard")
    bounds = first.groupBy("block").applyInPandas(limits_of, "block long, asked binary, scores binary, limits binary")
    sent = _sent(gathered.join(bounds, "block", "left"), cells).join(F.broadcast(parts), "cell")
    others = sent.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("shard != home")
    rest = map_arrow(others.join(grown, ["cell", "shard", "dims"]).select(*asked), run, result)
    ranked = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(rest).withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
