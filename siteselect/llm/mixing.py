"""Mixing sources to target weights by entropy balancing, and rounding the rates into copies."""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteselect.llm.common import keep

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents that one rounding group holds about.
GROUP_ROWS = 1024


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, weight): the weights in turn to the sources by code point, null last.

    Sources are ranked without one task for all: each range partition counts its own and adds those before it.
    """
    spark = sources.sparkSession
    # a column that orders by UTF-8 bytes, which is the order of code points, and puts null last
    named = sources.select("source").distinct().withColumn("last", F.col("source").isNull())
    ranged = keep(named.repartitionByRange("last", "source").sortWithinPartitions("last", "source").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sources")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, rows = 0, []
    for part in sorted(counts):
        rows.append((part, before))
        before += counts[part]
    bases = spark.createDataFrame(rows, "part int, base long")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("base") + F.col("row")) % len(weights) + 1).cast("int"))
    return ranged.join(bases, "part").select("source", turn.alias("weight"))


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner", more: Column | None = None) -> DataFrame:
    """Join on source, where null equals null; right's other columns come after left's."""
    renamed = right.withColumnRenamed("source", "_source")
    on = F.col("source").eqNullSafe(F.col("_source"))
    return left.join(renamed, on if more is None else on & more, how).drop("_source")


def targets(totals: DataFrame, weights: DataFrame, ceiling: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target): shares of all sizes by weight, none above ceiling times its source's size.

    What stands above goes to the others by weight, again and again until none is above. Only sums reach the driver.
    """
    state = keep(_by_source(totals, weights).select("source", "source_size", "weight", F.lit(False).alias("full")), "shares")
    everything = state.agg(F.sum("source_size")).first()[0] or 0
    while True:
        held, open_weight = state.agg(F.sum(F.when(F.col("full"), ceiling * F.col("source_size"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        rest = everything - (held or 0.0)
        share = F.when(F.col("full"), ceiling * F.col("source_size")).otherwise(F.col("weight") * F.lit(rest / open_weight if open_weight else 0.0))
        above = ~F.col("full") & (share > ceiling * F.col("source_size"))
        if not open_weight or not state.where(above).limit(1).count():
            return state.withColumn("target", share.cast("double")).drop("full")
        state = keep(state.withColumn("full", F.col("full") | above), "shares")


def tilted(m: Column, size: Column, prior: Column, mean: Column, ceiling: float) -> Column:
    """The rate of a document: its prior tilted by exp(m * size / mean), kept below the ceiling. m may be infinite: then the rate is a bound, but for documents without words."""
    held = ceiling / (1 + (ceiling - prior) / prior * F.exp(-m * size / mean))
    return F.when(size == 0, prior).when(m == float("inf"), F.lit(ceiling)).when(m == float("-inf"), F.lit(0.0)).otherwise(held)


def multipliers(cells: DataFrame, wanted: DataFrame, ceiling: float = 3.0, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(source, m, mean): the multiplier under which the tilted rates of a source's documents bring its tokens to its target.

    Entropy balancing by document: of all rates between 0 and `ceiling` whose tokens come to the targets, those nearest to the priors in (bounded) relative
    entropy. A constraint's moment is a document's tokens, so that a rate is its prior tilted by the exponential of a multiple of them: a source that gives up
    words gives up those of its long documents first, and most short documents keep their rate. The dual is convex, with a multiplier for each source, and
    Newton's steps from 0 are aggregates over the cells (source, prior, size, n), so that no step reads the documents again. A step that leaves the
    bracket of the root halves it instead.

    A source that is to be taken `ceiling` times, or not at all, has no finite multiplier. Raises an error if `rounds` steps do not suffice.
    """
    state = wanted.where("source_size > 0").select("source", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.col("source_size").cast("double").alias("tokens"))
    ratio = F.col("target") / F.col("tokens")
    bound = F.when(ratio >= ceiling * (1 - 1e-12), F.lit(float("inf"))).when(ratio <= 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    state = keep(state.select("source", "target", "mean", bound.alias("m"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high")), "duals")
    for _ in range(rounds):
        rate = tilted(F.col("m"), F.col("size"), F.col("prior"), F.col("mean"), ceiling)
        now = _by_source(cells, state.where(F.abs("m") < float("inf"))).select("source", (F.col("n") * F.col("size")).alias("tokens"), (F.col("size") / F.col("mean")).alias("x"), rate.alias("rate"))
        sums = now.groupBy("source").agg(F.sum(F.col("tokens") * F.col("rate")).alias("got"), F.sum(F.col("tokens") * F.col("x") * F.col("rate") * (1 - F.col("rate") / ceiling)).alias("slope"))
        step = keep(_by_source(state, sums, "left"), "duals")
        worst = step.agg(F.max(F.abs(F.col("got") - F.col("target")) / F.greatest(F.lit(1.0), F.col("target")))).first()[0]
        if worst is None or worst <= tolerance:
            return state.select("source", "m", "mean")
        low = F.when(F.col("got") < F.col("target"), F.col("m")).otherwise(F.col("low"))
        high = F.when(F.col("got") > F.col("target"), F.col("m")).otherwise(F.col("high"))
        newton = F.col("m") + F.try_divide(F.col("target") - F.col("got"), F.col("slope"))
        inside = (newton > low) & (newton < high)
        state = step.select("source", "target", "mean", F.when(F.col("got").isNull(), F.col("m")).when(inside, newton).otherwise((low + high) / 2).alias("m"), low.alias("low"), high.alias("high"))
    raise RuntimeError(f"the multipliers have not converged in {rounds} rounds")


def _exchange(entries: list[tuple[int, float, int]], taken: list[int], most: int, carry: float) -> tuple[int, int] | None:
    """The document to take once more, and the one to take once less, whose sizes differ by what is nearest to the carry; none if that is no gain."""
    less = sorted((size, i) for i, (size, _, _) in enumerate(entries) if size and taken[i])
    best, pair = abs(carry) - 1e-6, None
    for i, (size, _, n) in enumerate(entries):
        if size and taken[i] < most * n:
            at = bisect.bisect_left(less, (size - carry,))
            for other, j in less[max(at - 1, 0) : at + 1]:
                if abs(carry - size + other) < best:
                    best, pair = abs(carry - size + other), (i, j)
    return pair


def _round(group: pd.DataFrame, ceiling: float = 3.0) -> pd.DataFrame:
    """`taken`: copies of a group's documents, together for the n rows that are equal. Each rate goes to one of its two neighbours, large documents first,
    and what is lost or won by one is carried to the next. What is left at the end, as where a large document comes with few small ones, is settled
    by whole copies of the largest documents that it holds and that have room, between no copy and the ceiling, and then by copies of one for another."""
    group = group.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], kind="stable")
    most, carry, taken = math.floor(ceiling), 0.0, []
    entries = list(zip(group["size"].tolist(), group["rate"].tolist(), group["n"].tolist(), strict=True))
    for size, rate, n in entries:
        low = min(math.floor(rate), most)
        more = 0
        if size and rate > low:
            more = min(max(math.floor((carry + (rate - low) * size * n) / size + 0.5), 0), min(1, most - low) * n)
            carry += (rate - low) * size * n - more * size
        taken.append(low * n + more)
    settled = False
    while not settled:
        settled = True
        for i, (size, _, n) in enumerate(entries):
            # as many copies as bring the carry nearer to 0; each change makes it smaller, so this ends
            more = max(math.ceil(abs(carry) / size - 0.5), 0) if size else 0
            more = min(more, most * n - taken[i]) if carry > 0 else -min(more, taken[i])
            if more:
                taken[i] += more
                carry -= more * size
                settled = False
        if settled and abs(carry) > 0.5 and (pair := _exchange(entries, taken, most, carry)):
            up, down = pair
            taken[up] += 1
            taken[down] -= 1
            carry -= entries[up][0] - entries[down][0]
            settled = False
    return group.assign(taken=pd.array(taken, dtype="int64"))


def _each(rounded: DataFrame, chunk: int = 4096) -> DataFrame:
    """The n equal rows of an entry apart, with its copies spread evenly over them; no array is longer than n / chunk or chunk."""
    parts = rounded.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {chunk}"))))
    start = F.col("_part") * chunk
    rows = parts.withColumn("_at", F.explode(F.sequence(start, F.least(F.col("n") - 1, start + chunk - 1))))
    return rows.withColumn("copies", F.expr("(_at + 1) * taken div n - _at * taken div n"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, ceiling: float = 3.0, prior_col: str | None = None) -> DataFrame:
    """(doc_id, row, source, size, source_size, target, rate, copies) for each row of docs; taken words are size * copies.

    Sources get `weights` in turn by code point, null last (a null source is a source). Documents without words have their prior as rate and count no
    words; a source without words has target 0 and copies 0. No document is taken more than `ceiling` times. `row` is a hash of the text.
    Rows equal in id, text, source and prior are counted before they are shuffled, and share their copies evenly.
    prior_col: rates that documents of a source shall keep among each other (above 0, below ceiling; null: 1); without, all are 1.
    Reruns agree: rounding groups are dealt by a hash of id and text, and order within by size and id. A large source has as many groups as it needs,
    and many rows of one id, or of none, are many groups.
    """
    ids = docs.schema[id_col].dataType.simpleString()
    prior = F.coalesce(F.least(F.greatest(F.col(prior_col).cast("double"), F.lit(1e-6)), F.lit(ceiling * 0.999)), F.lit(1.0)) if prior_col else F.lit(1.0)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(source_col).alias("source"), words.alias("size"), prior.alias("prior"))
    rows = keep(named.groupBy("doc_id", "row", "source", "size", "prior").agg(F.count("*").alias("n")), "sizes")
    cells = keep(rows.groupBy("source", "prior", "size").agg(F.sum("n").alias("n")), "cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    wanted = keep(_by_source(targets(totals, cyclic_weights(totals, weights), ceiling), totals.select("source", "n")), "targets")
    found = multipliers(cells, wanted, ceiling)
    info = _by_source(wanted.withColumn("groups", F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_ROWS))), found, "left")
    info = keep(info.select("source", "source_size", "target", "groups", "m", "mean"), "multipliers")
    rate = F.when(F.col("m").isNull(), F.lit(0.0)).otherwise(tilted(F.col("m"), F.col("size"), F.col("prior"), F.col("mean"), ceiling))
    group = F.pmod(F.xxhash64("doc_id", "row"), "groups").alias("grp")
    joined = _by_source(rows, info).select("doc_id", "row", "source", "size", "source_size", "target", rate.alias("rate"), "n", group)
    names = ["doc_id", "row", "source", "size", "source_size", "target", "rate"]
    schema = f"doc_id {ids}, row long, source string, size long, source_size long, target double, rate double, n long, taken long"

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        return _round(group, ceiling)[[*names, "n", "taken"]]

    return _each(joined.groupBy("source", "grp").applyInPandas(rounded, schema)).select(*names, "copies")


def expand(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as `mixed`, the result of `mix`, says. Rows equal in id, text and source each take the rounded mean of their copies."""
    each = mixed.groupBy(F.col("doc_id").alias("_mix_id"), F.col("row").alias("_mix_row"), F.col("source").alias("_mix_source")).agg(F.round(F.avg("copies")).cast("int").alias("_mix_copies")).where("_mix_copies > 0")
    same = F.col(id_col).eqNullSafe(F.col("_mix_id")) & (F.xxhash64(text_col) == F.col("_mix_row")) & F.col(source_col).eqNullSafe(F.col("_mix_source"))
    joined = docs.join(each, same).drop("_mix_id", "_mix_row", "_mix_source")
    return joined.withColumn("_mix_copies", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).drop("_mix_copies")
