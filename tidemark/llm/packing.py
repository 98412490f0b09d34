"""Best-fit packing by hierarchical residuals.

Documents are items of as many tokens as they have words. They are spread over leaf nodes by a hash of their row number;
each node packs its items best-fit, longest first, and emits the bins that are nearly full. Underfull bins go up the tree
as items of their own, all of them: fewer nodes pack them again, until one node, the root, is left. The least fill that
lets a bin leave falls from level to level. Before that only bins leave in whose space not even the least filled bin that
is about would go, so that no round could have filled them.

A node takes at most ``fan_in * leaf_items`` items: the tree narrows by fan_in, but never below the nodes that so many
need. Where nearly all underfull bins are over half full, so that hardly any two merge, a level may stay as wide as the
last; the bins are mixed anew there, and the level that merges less than one in ``STALLED`` of them is the last one. At
most one bin of each of its nodes is half full or less. Only ids and lengths move. Defined results:

* every token of every document is in exactly one bin; a document longer than a bin is cut into full bins and a rest;
* documents without words (null, empty, blank) have nothing to pack and are in no bin;
* repeated rows and null ids are packed like others; ties in length are broken by id (null ids last), then row number;
* ids are integers; an empty table gives no bins; other columns are not read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, stored

CAPACITY = 2048
LEAF_ITEMS = 50_000
FAN_IN = 8
#: A level that stays as wide and merges fewer of its bins than one in so many is the last.
STALLED = 1000
#: Fill from which a bin is emitted, by level; at the root all are.
FULL = (0.99, 0.98, 0.96, 0.93, 0.9)

SCHEMA = "bin_id bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, tokens bigint, emitted boolean, node bigint"
_ARROW = pa.schema([
    ("bin_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("tokens", pa.int64()), ("emitted", pa.bool_()), ("node", pa.int64()),
])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers. Items in the given order go where the least space that suffices is left.

    ``open_`` has bit r set if a bin with r space is open, so the best fit is the lowest set bit from the size on.
    """
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for item, size in enumerate(sizes):
        rest = open_ >> size
        if rest:
            space = (rest & -rest).bit_length() - 1 + size
            stack = by_space[space]
            b = stack.pop()
            if not stack:
                open_ ^= 1 << space
            bins[b].append(item)
        else:
            space, b = capacity, len(bins)
            bins.append([item])
        space -= size
        if space:
            if not by_space[space]:
                open_ |= 1 << space
            by_space[space].append(b)
    return bins


def _pack(table: pa.Table, capacity: int, level: int, last: bool) -> pa.Table:
    """One node: items with their pieces in, bins out."""
    node = table.column("node")[0].as_py()
    ids, starts, lengths = (table.column(c).to_pylist() for c in ("doc_ids", "starts", "lengths"))
    tokens, keys = table.column("tokens").to_pylist(), table.column("key").to_pylist()
    order = sorted(range(len(tokens)), key=lambda i: (-tokens[i], ids[i][0] is None, ids[i][0] or 0, starts[i][0], keys[i]))
    bins = [[order[i] for i in b] for b in best_fit([tokens[i] for i in order], capacity)]
    fill = [sum(tokens[i] for i in b) for b in bins]
    least = FULL[min(level, len(FULL) - 1)] * capacity
    join = lambda x, b: [v for i in b for v in x[i]]
    return pa.table([
        [(level << 58) | (node << 26) | k for k in range(len(bins))], [join(ids, b) for b in bins], [join(starts, b) for b in bins],
        [join(lengths, b) for b in bins], fill, [last or f >= least for f in fill], [node] * len(bins),
    ], schema=_ARROW)


def _packer(capacity: int, level: int, last: bool):
    def node(table: pa.Table) -> pa.Table:
        return _pack(table, capacity, level, last)

    return node


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, leaf_items: int = LEAF_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Bins: bin_id, and for each piece in them doc_ids, starts and lengths (in words of the document), and their sum tokens."""
    sized = docs.select(F.col(id_col).cast("bigint").alias("id"), F.expr(WORDS.format(f"`{text}`")).cast("bigint").alias("n")).where("n > 0")
    cut = f"explode(transform(sequence(0L, (n - 1) div {capacity}), k -> named_struct('start', k * {capacity}, 'size', least(n - k * {capacity}, {capacity}))))"
    pieces = stored(sized.select("id", F.expr(cut).alias("p")).select("id", "p.*", F.monotonically_increasing_id().alias("key")), "pieces")
    shape = [F.array("id").alias("doc_ids"), F.array("start").alias("starts"), F.array("size").alias("lengths"), F.col("size").alias("tokens")]
    out = [pieces.where(f"size = {capacity}").select((-1 - F.col("key")).alias("bin_id"), *shape)]
    items = pieces.where(f"size < {capacity}").select(*shape, "key")
    before = items.count()
    nodes, level = max(1, math.ceil(before / leaf_items)), 0
    while True:
        spread = items.withColumn("node", F.pmod(F.xxhash64("key"), F.lit(nodes)))
        bins = stored(spread.groupBy("node").applyInArrow(_packer(capacity, level, nodes == 1), SCHEMA), f"bins{level}")
        under = bins.where("not emitted").agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("least")).first()
        rows = bins.select("bin_id", "doc_ids", "starts", "lengths", "tokens", "emitted")
        wide = max(math.ceil(nodes / fan_in), math.ceil(under["n"] / (fan_in * leaf_items)))
        if not under["n"] or (level and wide >= nodes and under["n"] > before * (1 - 1 / STALLED)):
            out.append(rows.drop("emitted"))
            break
        goes_up = ~F.col("emitted") & (F.lit(capacity) - F.col("tokens") >= under["least"])
        out.append(rows.where(~goes_up).drop("emitted"))
        items = rows.where(goes_up).select("doc_ids", "starts", "lengths", "tokens", F.col("bin_id").alias("key"))
        nodes, before, level = wide, under["n"], level + 1
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
