"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is a multiple m of its own size. Every document is taken floor(m) times, and
once more with probability frac(m). Which documents get the extra copy is decided by the cube
method: the vector of probabilities moves through the null space of the balancing constraints
(number of documents, number of tokens), each move bringing at least one probability to 0 or 1,
until only as many documents as constraints are undecided.

The flight runs in groups of at most `GROUP` documents of one source, so a source with a third of
all rows is many tasks. Each group leaves two documents undecided and `LANDING` that did not fly;
these meet in the next round, in groups again, until one group per source is left. What is open
then is the landing problem: all outcomes are compared and the one nearest to the source's token
target is taken. Every group orders its rows by
content and seeds its generator by its own number, so reruns and retried tasks decide alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import KEY, keyed, occurrences, packed, settle, texts
from tidemark.llm.manifest import ranked

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
GROUP = 4096
LANDING = 12
SEED = 20_251


def sizes(docs: DataFrame) -> DataFrame:
    """Words per document, split at ASCII white space; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(x.as_py().encode().split()) for x in batch.column("text")]
            kept = [batch.column(c) for c in (*KEY, "doc_id", "source")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], names=[*KEY, "doc_id", "source", "size"])

    read = keyed(docs, F.col("source").cast("string").alias("source"), texts())
    schema = f"{KEY[0]} LONG, {KEY[1]} LONG, doc_id LONG, source STRING, size LONG"
    return settle(read.mapInArrow(count, schema).withColumn("row", F.monotonically_increasing_id()))


def _numbered(counted: DataFrame) -> DataFrame:
    """Rows with `copy`, their number among rows of one doc_id and text; 0 where there is one."""
    repeated = settle(counted.groupBy(*KEY).count().filter("count > 1").select(*KEY))
    copies = occurrences(counted, repeated, KEY).select("row", "copy")
    return counted.join(copies, "row", "left").drop("row").fillna(0, ["copy"])


def targets(totals: dict, weights: tuple = WEIGHTS, most: float = MOST_COPIES) -> dict:
    """Target per source: shares by weight, none above `most` times its size, excess reshared."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(totals.values())), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * totals[s]]
        for s in full or open_:
            out[s] = float(most * totals[s]) if full else weight[s] * unit
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def source_plan(counted: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """`targets` as a table, however many sources there are: src, name, source_size, target, whole, p.

    A source is capped where its share by weight would exceed its cap; the share of a unit of weight rises
    as capped sources leave. Each step is one aggregate over the sources, whose three sums come to the driver.
    """
    totals = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(totals.select(F.lit("").alias("g"), "source", "source_size"), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("lo") % len(weights) + 1).cast("int"))
    placed = placed.select("lo", "source", "source_size", weight.cast("double").alias("weight"))
    placed = settle(placed.withColumn("cap", F.col("source_size") * float(most)))
    unit, capped = 0.0, -1
    while True:
        full = F.col("weight") * unit > F.col("cap")
        found = placed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("caps"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("full"),
        ).first()
        if found["full"] == capped or not found["open"]:
            break
        capped = found["full"]
        unit = (float(found["all"]) - (found["caps"] or 0.0)) / found["open"]
    target = F.least(F.col("cap"), F.col("weight") * unit)
    factor = F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))
    factor = F.when(F.col("source_size") > 0, factor).otherwise(0.0)
    return settle(
        placed.withColumn("target", target).select(
            F.col("lo").alias("src"), F.col("source").alias("name"), "source_size", "target",
            F.floor(factor).cast("int").alias("whole"), (factor - F.floor(factor)).alias("p"),
        )
    )


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities to 0 or 1, keeping their sum and their token total, until two are left."""
    p, s, dice = chance.astype(float).tolist(), size.astype(float).tolist(), iter(rng.random(2 * len(chance) + 8).tolist())
    live: list[int] = []
    for i in range(len(p)):
        if 0 < p[i] < 1:
            live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(live, u) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(live, u) if x)
            step = up if next(dice) * (up + down) < down else -down
            for k, x in zip(live, u):
                p[k] = min(1.0, max(0.0, p[k] + step * x))
                if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                    p[k] = float(round(p[k]))
            live = [k for k in live if 0 < p[k] < 1]
    return np.array(p)


def landing(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last undecided documents, all outcomes compared: tokens nearest to what was expected,
    then documents."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    outcomes = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    tokens = np.abs(outcomes @ size[open_] - chance[open_] @ size[open_])
    count = np.abs(outcomes.sum(1) - chance[open_].sum())
    out = chance.copy()
    out[open_] = outcomes[np.lexsort((count, np.round(tokens)))[0]] if len(open_) else 0
    return out


def fly_group(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight of a group in which LANDING documents of all sizes wait on the ground.

    Two documents that the flight leaves open may be the longest of all; with those that waited, the
    next round, and the landing at last, can make up for them.
    """
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    if len(open_) <= LANDING + 2:
        return chance
    ranked = open_[np.argsort(size[open_], kind="stable")]
    waiting = np.unique(ranked[np.linspace(0, len(ranked) - 1, LANDING).astype(int)])
    held = chance.copy()
    held[waiting] = 0
    out = flight(held, size, rng)
    out[waiting] = chance[waiting]
    return out


def _round(units: DataFrame, number: int, blocks: DataFrame) -> DataFrame:
    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", *KEY, "size", "copy"], kind="stable")
        rng = np.random.default_rng([SEED, number, int(rows.src.iloc[0]), int(rows.block.iloc[0])])
        size = rows["size"].to_numpy()
        p = fly_group(rows.p.to_numpy(), size, rng)
        return rows.assign(p=landing(p, size) if rows.blocks.iloc[0] == 1 else p)[columns]

    columns = units.columns
    # Repeated rows are dealt like others, by their number.
    dealt = F.when(F.col("copy") == 0, F.xxhash64(F.lit(number), *KEY)).otherwise(F.xxhash64(F.lit(number), *KEY, "copy"))
    block = F.pmod(dealt, F.col("blocks")).alias("block")
    dealt = units.join(blocks, "src").select(*columns, "blocks", block)
    return settle(dealt.groupBy("src", "block").applyInPandas(decide, units.schema))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_COPIES, group: int = GROUP) -> DataFrame:
    """One row per input row: key, doc_id, source, size, source_size, target, copies, taken.

    Null sources form one source, the last. Documents without words take no part. Repeated rows
    are decided one by one.
    """
    counted = sizes(docs)
    same = F.col("source").eqNullSafe(F.col("name"))
    known = _numbered(counted).join(source_plan(counted, weights, most), same).drop("name")
    start = F.when(F.col("size") == 0, 0.0).otherwise(F.col("p"))
    units = settle(known.withColumns({"p": start, "order": F.xxhash64(F.lit(SEED), *KEY, "source")}))
    done, number = None, 0
    while True:
        left = units.filter("p > 0 AND p < 1")
        blocks = left.groupBy("src").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))
        blocks = settle(blocks)
        decided = units.filter("p = 0 OR p = 1")
        done = decided if done is None else done.unionByName(decided)
        if blocks.isEmpty():
            break
        units, number = _round(left, number, blocks), number + 1
    copies = (F.col("whole") + F.col("p")).cast("int")
    copies = F.when(F.col("size") == 0, 0).otherwise(copies)
    return done.select(
        *KEY, "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it.

    Rows equal in doc_id, text and source are taken evenly, up to one copy, by their place in the table.
    """
    keys = [*KEY, "_k3"]
    origin = lambda source: F.xxhash64(source.isNull(), source.cast("string")).alias("_k3")
    taken = mix(docs, **options).groupBy(*KEY, origin(F.col("source"))).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows")
    )
    taken = settle(taken.filter("copies > 0"))
    rows = packed(docs).select(*KEY, origin(F.col("row")["source"]), "row")
    single = rows.join(taken.filter("rows = 1"), keys).select("row", "copies")
    several = taken.filter("rows > 1")
    if not several.isEmpty():
        same = rows.join(several.select(*keys), keys, "left_semi").withColumnRenamed("row", "doc")
        same = settle(same.withColumn("row", F.monotonically_increasing_id()))
        placed = occurrences(same, several.select(*keys), keys).join(several, keys)
        share = F.expr("copies div rows + CAST(copy < copies % rows AS INT)").alias("copies")
        placed = same.select("row", "doc").join(placed.select("row", share), "row")
        single = single.unionByName(placed.select(F.col("doc").alias("row"), "copies").filter("copies > 0"))
    repeat = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return single.select("row", repeat).select("row.*")
