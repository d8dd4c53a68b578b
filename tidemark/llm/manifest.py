"""Merkle manifest of documents: one digest per row, source and dataset, with inclusion proofs.

Leaves are digests of rows. Those of a source, in order, are hashed in runs of `FAN` to nodes, these
again, until one is left, the subroot; the subroots of all sources are hashed alike to the root.

Every node is labelled with the interval [lo, hi) of leaf ranks that it covers. Levels are cut into
*bands* of `BAND` levels: a row of a band is one block, an interval of `WIDTH` nodes of its lowest
level together with all levels above them, so 50 billion leaves take four bands instead of 23 rounds.

* Upwards, a block's top is a node of the next band.
* Downwards, blocks meet the ancestor whose interval contains theirs: an equi-join on the band's
  bucket of `lo`, with containment as its condition. A node's siblings are the intervals that its own
  leaves over in its parent's, and the nodes that cover them are read off the parent's block.

Ranks come from one range sort over (source, order), counted by source and sorted part: no task
holds a source, so a source of a third of all rows is as many parts and blocks as it needs.

Null columns hash as `-`, a null source is a source of its own and comes first; null doc_ids come first.
Rows that tie in doc_id are ordered by their digest; equal rows are a leaf each. An empty table
has no leaves. All digests are lowercase hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import settle

FAN = 3
BAND = 6
WIDTH = FAN**BAND
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    counted = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("-")).otherwise(counted)


def leaf(**changed: Column) -> Column:
    """Digest of a row; `changed` columns replace the row's own."""
    return hashed(*(_field(changed.get(name, F.col(name))) for name in FIELDS))


def group_key(source: Column) -> Column:
    """A source as a key without nulls that sorts as sources do: null first, then by UTF-8 bytes."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def ranked(rows: DataFrame, *order: str | Column) -> DataFrame:
    """`rows(g, ..)` with `lo`, the rank in its group by `order`, and `n`, the group's rows.

    The range sort numbers parts in ascending order; a row's rank is its distance from the first of its
    group in its part, behind the group's rows in earlier parts.
    """
    placed = settle(rows.orderBy("g", *order).withColumn("row", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("row", 33))
    runs = placed.groupBy("g", "part").agg(F.min("row").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("g")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = settle(
        runs.select(
            "g",
            "part",
            "first",
            F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"),
            F.sum("held").over(whole).alias("n"),
        )
    )
    lo = (F.col("base") + F.col("row") - F.col("first")).alias("lo")
    return placed.join(runs, ["g", "part"]).select(*rows.columns, lo, "n")


def _node(lo: Column, hi: Column, digest: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), digest.alias("digest"))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def _parent(run: Column) -> Column:
    return _node(F.get(run, F.lit(0))["lo"], F.element_at(run, -1)["hi"], hashed(_joined(run)))


def _parents(level: Column) -> Column:
    """The level above: a node for each run of `FAN`."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: _parent(F.slice(level, i * FAN + 1, F.lit(FAN))))


def _blocks(nodes: DataFrame, unit: int) -> DataFrame:
    """Blocks of `nodes(g, n, lo, hi, digest, own)`: g, n, lo, hi, own, levels l0 to l6.

    `unit` is the number of leaves below a full node, `n` the number of nodes of the group. Only as
    many levels are hashed as the group has; `own` is what came with the nodes, in their order.
    """
    item = F.struct("lo", "hi", "digest", "own")
    block = nodes.groupBy("g", "n", F.floor(F.col("lo") / (unit * WIDTH)).alias("bucket")).agg(
        F.sort_array(F.collect_list(item)).alias("items")
    )
    block = block.select(
        "g",
        "n",
        "bucket",
        F.transform("items", lambda x: x["own"]).alias("own"),
        F.transform("items", lambda x: _node(x["lo"], x["hi"], x["digest"])).alias("l0"),
    )
    for k in range(BAND):
        below = F.col(f"l{k}")
        block = block.withColumn(f"l{k + 1}", F.when(F.col("n") > FAN**k, _parents(below)).otherwise(below))
    top = F.get(F.col(f"l{BAND}"), F.lit(0))
    return block.withColumns({"lo": top["lo"], "hi": top["hi"], "top": top["digest"]})


def bands(leaves: DataFrame) -> list[DataFrame]:
    """Blocks of all bands, lowest first, of `leaves(g, n, lo, digest, own)`."""
    found, unit = [], 1
    nodes = leaves.withColumn("hi", F.col("lo") + 1)
    while True:
        found.append(settle(_blocks(nodes, unit)))
        rest = found[-1].filter(F.col("n") > WIDTH)
        if rest.isEmpty():
            return found
        unit *= WIDTH
        count = F.ceil(F.col("n") / WIDTH).cast("long").alias("n")
        nodes = rest.select("g", count, "lo", "hi", F.col("top").alias("digest"), F.lit(None).cast("string").alias("own"))


def subroots(blocks: list[DataFrame]) -> DataFrame:
    """(g, digest) of every group: the top of its one highest block."""
    heads = [b.filter(F.col("n") <= WIDTH).select("g", F.col("top").alias("digest")) for b in blocks]
    out = heads[0]
    for more in heads[1:]:
        out = out.unionByName(more)
    return out


def _steps(node: Column, unit: int) -> Column:
    """Siblings of a block's node on every level, lowest first, as (left, right) digests."""

    def covering(level: int, lo: Column, hi: Column) -> Column:
        """Digests of the nodes of a level that make up the interval [lo, hi)."""
        wide = unit * FAN**level
        first = F.floor((lo - F.col("lo")) / wide).cast("int") + 1
        return _joined(F.slice(F.col(f"l{level}"), first, F.ceil((hi - lo) / wide).cast("int")))

    def ancestor(level: int) -> Column:
        """The node of a level whose interval contains the node's."""
        return F.get(F.col(f"l{level}"), F.floor((node["lo"] - F.col("lo")) / (unit * FAN**level)).cast("int"))

    steps = []
    for k in range(BAND):
        inner, outer = ancestor(k) if k else node, ancestor(k + 1)
        left = covering(k, outer["lo"], inner["lo"]).alias("left")
        step = F.struct(left, covering(k, inner["hi"], outer["hi"]).alias("right"))
        steps.append(F.when(F.col("n") > FAN**k, step))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _walked(unit: int) -> Column:
    """A block's nodes with their whole paths."""

    def walked(x: Column, i: Column) -> Column:
        kept = [x[c].alias(c) for c in ("lo", "hi", "digest")]
        return F.struct(*kept, F.get("own", i).alias("own"), F.concat(_steps(x, unit), F.col("path")).alias("path"))

    return F.transform("l0", walked)


def paths(blocks: list[DataFrame], heads: DataFrame | None = None) -> DataFrame:
    """(g, lo, digest, own, path, tops) of every leaf of the groups.

    `path` lists the siblings from the leaf up, `tops` the group's top and what lies above it;
    `heads(g, path, tops)` says what does.
    """
    nodes = None
    for band in range(len(blocks) - 1, -1, -1):
        block, unit = blocks[band], WIDTH**band
        top = block.filter(F.col("n") <= WIDTH)
        if heads is None:
            top = top.withColumns({"path": F.array().cast(STEP), "tops": F.array("top")})
        else:
            top = top.join(heads, "g").withColumn("tops", F.concat(F.array("top"), "tops"))
        if nodes is not None:
            level = F.floor(F.col("a_lo") / (unit * WIDTH)).alias("bucket")
            above = nodes.select("g", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), "path", "tops")
            above = above.select("*", level)
            contained = block.filter(F.col("n") > WIDTH).join(above, ["g", "bucket"])
            contained = contained.filter((F.col("a_lo") <= F.col("lo")) & (F.col("hi") <= F.col("a_hi")))
            top = top.unionByName(contained.drop("a_lo", "a_hi"))
        nodes = top.select("g", F.explode(_walked(unit)).alias("x"), "tops").select("g", "x.*", "tops")
        if band:
            nodes = settle(nodes)
    return nodes


def proofs(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, claimed, path, subroot, root.

    `claimed` is the leaf that a holder of the row presents, by default the row's own. The path leads
    from leaf to root: per level the digests left and right of it, joined.
    """
    own = docs.select(
        group_key(F.col("source")).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf().alias("digest"),
        (leaf() if claimed is None else claimed).alias("claimed"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = ranked(settle(own), F.col("doc_id").asc_nulls_first(), "digest", "tie")
    rows = rows.select("g", "n", "lo", "digest", F.struct("doc_id", "claimed").alias("own"))
    documents = bands(rows)
    sources = subroots(documents).select(F.lit("").alias("g"), F.col("g").alias("own"), "digest")
    heads = paths(bands(ranked(sources, "own")))
    heads = settle(heads.select(F.col("own").alias("g"), "path", "tops"))
    return paths(documents, heads).select(
        "own.doc_id",
        F.col("digest").alias("leaf"),
        "own.claimed",
        "path",
        F.get("tops", F.lit(0)).alias("subroot"),
        F.get("tops", F.lit(1)).alias("root"),
    )


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, start, lambda d, s: hashed(s["left"], d, s["right"]))


def without_line_ends() -> Column:
    """Leaf of a row whose text lost its line ends, where 2 divides crc32 of doc_id's decimal text."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return leaf(text=text)


def digest(found: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    siblings = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        hashed(F.array_join(siblings, "")).alias("proof_sha256"),
        folded(F.col("claimed"), F.col("path")).alias("folded_root"),
    ).withColumns({"verified": F.col("folded_root") == F.col("root")}).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
