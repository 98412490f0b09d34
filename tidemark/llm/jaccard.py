"""N-gram Jaccard join by signature trees.

Documents with the same set of word n-grams form one class. Classes are the items of signature trees: a node has the OR
of its items' token bitmaps, their size range, and the most n-grams of an item that share a bit with another. Two trees
are traversed together from their roots; pairs of nodes whose largest possible overlap is too small for the threshold are
dropped, so that what is left at the items is verified with whole sets of 64-bit n-grams.

A tree holds classes of one size band that share the least hash among their n-grams that are not common, so near copies
mostly share a tree; a group of classes of any size is cut into trees of bounded size. Which pairs of trees are traversed
is found exactly, by prefixes: with n-grams in any fixed order (here: those that a count sketch knows as rare first), two
sets that reach the threshold have ``COMMON`` n-grams (or as many as they must share at least) in common among the first
``size - ceil(threshold * size) + COMMON`` of each. Groups that share as many are paired, once, whatever number of n-grams
pairs them; so no link between different sets is lost, and pairs of classes are counted where they are verified, never
listed (but by ``similar_pairs``, whose result they are). Neither the sketch nor the choice of trees affects results.

Nothing caps partners or candidates. Work grows with the pairs of groups that share rare n-grams, and with the square of
a cluster of different near copies, in blocks that are spread over tasks; memory does not. Defined results:

* ids are integers; a null or empty text, or one without words, has no n-grams and no partner;
* a text of fewer than n words has one n-gram, all its words; texts may be of any length;
* repeated rows are members of one class, a row for each; a null id is no class's id unless all its ids are null;
* an empty table gives an empty table; other columns are not read (the join) or pass through (the dedup).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, bounded_broadcast, bounds, discard, packed, runs, sliced, stored
from .tokens import grams, mix, raw, words

N = 3
THRESHOLD = 0.6
#: Common n-grams that pair two groups; more of them make fewer pairs of groups and longer prefixes.
COMMON = 3
#: Counters of the sketch of n-gram frequencies, which is broadcast with a byte for each, and in how many blocks it is summed.
COUNTERS, BLOCKS = 1 << 20, 256
#: Of how many least hashes of a set the first that is not common picks its group.
LOW = 8
#: A size band's upper end is this many times its lower end.
BAND = 1.25
TREE_CLASSES, TREE_GRAMS = 512, 1 << 19
LEAF, FAN_OUT = 8, 8
#: A bitmap has at least this many bits, and four for each n-gram of the largest set of its band.
LEAST_BITS, BITS_A_GRAM = 256, 4
#: Groups that share an n-gram and are paired in one go; of more, blocks of this size are paired by Spark.
LIST = 1 << 15
#: Classes of a group that one task makes trees of, and partners of a tree that one task traverses.
GROUP_CLASSES, PARTNERS = 1 << 16, 1 << 12
#: Cells of the matrices that verification and traversal make at a time; more is worked off in tiles.
CELLS = 1 << 22

_SALT = np.uint64(0x5851F42D4C957F2D)
_HOT = np.uint8(128)

SIGNED = "id bigint, doc_key bigint, class binary, size int, low binary, bitmap binary, block int, counts binary"
TREES = "tree binary, grp bigint, n int, sizes binary, classes binary, bitmaps binary"
FOUND = "home binary, part int, guest binary, pairs binary, need_home array<struct<idx:int,class:binary>>, need_guest array<struct<idx:int,class:binary>>"


# ---- sets, sizes and bits ------------------------------------------------------------------------------------------


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each row."""
    data, offs = raw(batch.column("text"))
    _, _, hashes, at = words(data, offs)
    all_grams = grams(hashes, at, n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            yield np.unique(all_grams[a : b - n + 1])
        elif b > a:
            yield grams(hashes[a:b], np.array([0, b - a]), b - a)[:1]
        else:
            yield hashes[:0]


def _class(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _band(size: int) -> int:
    return int(math.log(size) / math.log(BAND))


def width(band: int) -> int:
    """Bits of the bitmaps of a band's sets: a power of two, so that a wider bitmap folds onto a narrower one."""
    return max(LEAST_BITS, 1 << math.ceil(math.log2(BITS_A_GRAM * BAND ** (band + 1))))


def _bits(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, np.uint8)
    out[(s >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little")


def _low(s: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The n-grams of the least hashes m, in the order of these."""
    pick = np.argpartition(m, LOW)[:LOW] if len(m) > LOW else np.arange(len(m))
    return s[pick[np.argsort(m[pick])]]


def _counter(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(40)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _group(low: np.ndarray, size: int, levels: np.ndarray) -> int:
    """47 bits of the hash that picks the group and 8 bits of the size band, so that a value (group, share) is positive."""
    known = levels[_counter(low)] & _HOT
    key = low[np.argmin(known)]  # the first that is not common; the first of all if all are
    return (int(mix(np.array([key]))[0]) >> 17) << 8 | _band(size)


# ---- first pass: classes and frequencies ---------------------------------------------------------------------------


def _fresh(batch: pa.RecordBatch, n: int, seen: set[bytes]) -> Iterator[tuple[int, bytes, np.ndarray | None, int]]:
    """Row, class, set and its size, of the rows that have n-grams; the set only where the class is new to the task."""
    for i, s in enumerate(_sets(batch, n)):
        if len(s):
            name = _class(s)
            yield i, name, None if name in seen else s, len(s)
            seen.add(name)


def _sign(n: int):
    """A row for each document, with size, least n-grams and bitmap where its class is new to the task; the task's counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in sliced(batches, "text"):
            rows = list(_fresh(batch, n, seen))
            if not rows:
                continue
            index, names, sets, sizes = zip(*rows)
            flat = np.concatenate([np.zeros(0, np.uint64), *(s for s in sets if s is not None)])
            np.add.at(counts, _counter(flat), np.uint32(1))
            hashes, at = mix(flat + _SALT), 0
            lows, bitmaps = [], []
            for s in sets:
                if s is not None:
                    lows.append(_low(s, hashes[at : at + len(s)]).tobytes())
                    bitmaps.append(_bits(s, width(_band(len(s)))).tobytes())
                    at += len(s)
                else:
                    lows.append(None)
                    bitmaps.append(None)
            pick, none = pa.array(index, pa.int64()), pa.nulls(len(rows))
            yield pa.record_batch(
                [
                    batch.column("id").take(pick), batch.column("doc_key").take(pick), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(lows, pa.binary()), pa.array(bitmaps, pa.binary()),
                    none.cast(pa.int32()), none.cast(pa.binary()),
                ],
                names=_NAMES,
            )
        if seen:
            none = pa.nulls(BLOCKS)
            yield pa.record_batch(
                [none.cast(t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())] + [pa.array(range(BLOCKS), pa.int32()), binary_column(counts.reshape(BLOCKS, -1))], names=_NAMES
            )

    return task


_NAMES = [c.split(" ")[0] for c in SIGNED.split(", ")]


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // BLOCKS, np.int64)
    for part in table.column("counts").to_pylist():
        total += np.frombuffer(part, np.uint32)
    return pa.table([table.column("block").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])


def _levels(signed: DataFrame) -> np.ndarray:
    """For each counter the logarithm of its count in six bits, and a mark on those far above the average."""
    blocks = signed.where("counts is not null").select("block", "counts").groupBy("block").applyInArrow(_sum, "block int, counts binary")
    total = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for row in blocks.collect():  # COUNTERS numbers, whatever the size of the data
        total[row["block"]] = np.frombuffer(row["counts"], np.int64)
    counts = total.ravel()
    return np.minimum(63, 1.5 * np.log2(np.maximum(counts, 1))).astype(np.uint8) | np.where(counts > 4 * counts.mean() + 64, _HOT, 0).astype(np.uint8)


# ---- second pass: prefixes -----------------------------------------------------------------------------------------


def prefix_length(n: int, threshold: float) -> int:
    """How many of n n-grams to look at, in any fixed order: of two sets that reach the threshold, the first ``COMMON`` shared ones are among these in both."""
    return min(n, n - math.ceil(threshold * n - 1e-9) + COMMON)


def _route(n: int, threshold: float, levels):
    """Rows (token, value) of each class's prefix, rare n-grams first.

    value: the group, and in the low 8 bits what share of the set can still be in common there, rounded up.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = levels.value
        seen: set[bytes] = set()
        for batch in sliced(batches, "text"):
            sets = [s for _, _, s, _ in _fresh(batch, n, seen) if s is not None]
            if not sets:
                continue
            flat = np.concatenate(sets)
            hashes = mix(flat + _SALT)
            ranked = (own[_counter(flat)].astype(np.uint64) & np.uint64(63)) << np.uint64(58) | flat >> np.uint64(6)
            at, tokens, lengths, groups_ = 0, [], [], []
            for s in sets:
                end = at + len(s)
                lengths.append(prefix_length(len(s), threshold))
                tokens.append(np.sort(ranked[at:end])[: lengths[-1]])
                groups_.append(_group(_low(s, hashes[at:end]), len(s), own))
                at = end
            count = np.array(lengths)
            size = np.repeat(np.array([len(s) for s in sets]), count)
            place = np.arange(len(size)) - np.repeat(np.cumsum(count) - count, count)
            share = np.ceil(np.minimum(1.0, (size - 1 - place + COMMON) / size) * 255).astype(np.int64)
            yield pa.record_batch([np.concatenate(tokens).view(np.int64), np.repeat(np.array(groups_, np.int64) << 8, count) | share], names=["token", "value"])

    return task


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Tokens and values of whole runs of equal tokens; a run of over LIST rows comes alone and in pieces, marked False."""
    token, value = np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = None  # the token of which pieces came
    for batch in batches:
        token = np.concatenate([token, batch.column("token").to_numpy()])
        value = np.concatenate([value, batch.column("value").to_numpy()])
        if cut is not None and len(token):
            end = int(np.searchsorted(token, cut, "right"))
            if end:
                yield token[:end], value[:end], False
                token, value = token[end:], value[end:]
            if len(token):
                cut = None
        if not len(token):
            continue
        last = int(np.searchsorted(token, token[-1]))
        if last:
            yield token[:last], value[:last], True
            token, value = token[last:], value[last:]
        if len(token) > LIST:
            cut = token[0]
            yield token, value, False
            token, value = token[:0], value[:0]
    if len(token):
        yield token, value, True


def _meet(threshold: float):
    """Pairs of groups (a < b) of equal tokens that may reach the threshold; for long lists the rows as they are, by blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[int, int] = {}  # rows so far of the one long list that is being read
        for token, value, whole in _lists(batches):
            if not whole:
                done = block.get(int(token[0]), 0)
                block = {int(token[0]): done + len(token)}
                yield _met(value, np.zeros_like(value), token, (done + np.arange(len(token))) // LIST)
                continue
            a, b = _paired(token, value, value[:0], value[:0], threshold)
            if len(a):
                yield _met(a, b, np.zeros_like(a), np.full(len(a), -1))

    return task


def _met(a, b, token, block) -> pa.RecordBatch:
    return pa.record_batch([a.astype(np.int64), b.astype(np.int64), token.astype(np.int64), block.astype(np.int32)], names=["a", "b", "token", "block"])


def _paired(token: np.ndarray, value: np.ndarray, other_token: np.ndarray, other: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different groups of one token whose sizes and shares allow the threshold; with ``other``, pairs across only."""
    side = np.repeat([0, 1], [len(value), len(other)])
    token, value = np.concatenate([token, other_token]), np.concatenate([value, other])
    order = np.lexsort((value, side, token))
    token, value, side = token[order], value[order], side[order]
    group = value >> 8
    # Rows of a group are in a row, the one with the largest share last.
    last = np.ones(len(token), bool)
    last[:-1] = (token[1:] != token[:-1]) | (side[1:] != side[:-1]) | (group[1:] != group[:-1])
    token, group, side, share = token[last], group[last], side[last], (value[last] & 255) / 255
    gain = share * (1 + threshold) / threshold - 1
    at = bounds(token) if len(token) else np.zeros(1, np.int64)
    many = np.flatnonzero(np.diff(at) > 1)
    apart = math.ceil(math.log(1 / threshold) / math.log(BAND)) + 1
    out_a, out_b = [], []

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        good = (gain[x] * gain[y] >= 1 - 1e-9) & (np.abs((group[x] & 255) - (group[y] & 255)) <= apart) & (group[x] != group[y])
        if len(other):
            good &= side[x] != side[y]
        x, y = group[x[good]], group[y[good]]
        out_a.append(np.minimum(x, y))
        out_b.append(np.maximum(x, y))

    pairs = many[np.diff(at)[many] == 2]
    keep(at[pairs], at[pairs] + 1)
    for k in many[np.diff(at)[many] > 2].tolist():
        index = np.arange(at[k], at[k + 1])
        index = index[gain[index] * gain[index].max() >= 1 - 1e-9]
        for start in range(0, len(index), tile := max(1, CELLS // max(1, len(index)))):
            x, y = np.meshgrid(np.arange(start, min(start + tile, len(index))), np.arange(len(index)), indexing="ij")
            x, y = index[x[x < y]], index[y[x < y]]
            keep(x, y)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (group[:0], group[:0])


def _meet_blocks(threshold: float):
    """Rows of two blocks of one token's list, sorted by (token, i, j, block): the pairs of groups across them, or within one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "pair"):
            at = bounds(np.array(table.column("pair").to_pylist(), object))
            token, value, block = (table.column(c).to_numpy() for c in ("token", "value", "block"))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                cut = s + int(np.searchsorted(block[s:e], block[s], "right"))
                a, b = _paired(token[s:cut], value[s:cut], token[cut:e], value[cut:e], threshold)
                if len(a):
                    yield pa.record_batch([a, b], names=["a", "b"])

    return task


def _group_pairs(docs: DataFrame, levels, n: int, threshold: float) -> DataFrame:
    """Pairs of different groups (a < b) that share as many rare n-grams as sets that reach the threshold must."""
    tokens = docs.select("text").mapInArrow(_route(n, threshold, levels), "token bigint, value bigint")
    met = stored(tokens.repartition("token").sortWithinPartitions("token", "value").mapInArrow(_meet(threshold), "a bigint, b bigint, token bigint, block int"), "met")
    pairs = met.where("block < 0").select("a", "b")
    long = met.where("block >= 0").select("token", F.col("a").alias("value"), "block")
    blocks = long.groupBy("token").agg(F.max("block").alias("most"))
    # Every row goes to each pair of blocks that its own is in.
    both = long.join(bounded_broadcast(stored(blocks, "long"), 32), "token").select("token", "value", "block", F.explode(F.sequence(F.lit(0), "most")).alias("with"))
    both = both.select("token", "value", "block", F.concat_ws(" ", "token", F.least("block", "with"), F.greatest("block", "with")).alias("pair"))
    pairs = pairs.unionByName(both.repartition("pair").sortWithinPartitions("pair", "block").mapInArrow(_meet_blocks(threshold), "a bigint, b bigint"))
    lower = F.pow(F.lit(BAND), F.greatest(F.col("a").bitwiseAND(255), F.col("b").bitwiseAND(255)))
    need = F.least(F.lit(COMMON), F.greatest(F.lit(1), F.ceil(F.lit(threshold) * lower - 1e-6)))
    return pairs.groupBy("a", "b").count().where(F.col("count") >= need).select("a", "b")


# ---- trees ---------------------------------------------------------------------------------------------------------


class Tree:
    """Levels of nodes, items first; each level is OR of bitmaps, least and largest size, and largest excess by node."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray) -> None:
        """bitmaps: a row of 64-bit words for each item."""
        self.levels = [(bitmaps, sizes, sizes, sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64))]
        self.steps = [1]
        while len(self.levels[-1][1]) > 1:
            b, low, high, excess = self.levels[-1]
            step = FAN_OUT if len(self.levels) > 1 else LEAF
            at = np.arange(0, len(low), step)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))
            self.steps.append(step)

    def folded(self, words: int) -> Tree:
        """The tree with bitmaps of fewer words."""
        bitmaps, sizes, *_ = self.levels[0]
        while bitmaps.shape[1] > words:
            half = bitmaps.shape[1] // 2
            bitmaps = bitmaps[:, :half] | bitmaps[:, half:]
        return Tree(sizes, bitmaps)


def traverse(x: Tree, y: Tree, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of items whose largest possible overlap allows the threshold; of one tree with itself those with i < j."""
    words = min(x.levels[0][0].shape[1], y.levels[0][0].shape[1])
    x, y = (t if t.levels[0][0].shape[1] == words else t.folded(words) for t in (x, y))
    dx, dy = len(x.levels) - 1, len(y.levels) - 1
    a = b = np.zeros(1, np.int64)
    while True:
        keep = _possible(x.levels[dx], y.levels[dy], a, b, threshold)
        if same:
            keep &= (a <= b) if dx else (a < b)
        a, b = a[keep], b[keep]
        if not dx and not dy or not len(a):
            return a, b
        deep = max(dx, dy)
        if dx == deep:
            a, b = _children(a, b, x.steps[dx], len(x.levels[dx - 1][1]))
        if dy == deep:
            b, a = _children(b, a, y.steps[dy], len(y.levels[dy - 1][1]))
        dx, dy = dx - (dx == deep), dy - (dy == deep)


def _children(a: np.ndarray, b: np.ndarray, step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of each a with its b."""
    x = (a[:, None] * step + np.arange(step)).ravel()
    keep = x < n
    return x[keep], np.repeat(b, step)[keep]


def _possible(x, y, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which node pairs may hold a pair of items that reaches the threshold.

    n-grams in common have their bits in both bitmaps, and at most ``excess`` of an item's n-grams share a bit with another.
    """
    bits_x, low_x, high_x, excess_x = x
    bits_y, low_y, high_y, excess_y = y
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), tile := max(1, CELLS // bits_x.shape[1])):
        i, j = a[k : k + tile], b[k : k + tile]
        overlap = np.bitwise_count(bits_x[i] & bits_y[j]).sum(1, dtype=np.int64) + np.minimum(excess_x[i], excess_y[j])
        overlap = np.minimum(overlap, np.minimum(high_x[i], high_y[j]))
        fits_ = (high_x[i] >= threshold * low_y[j] - 1e-9) & (high_y[j] >= threshold * low_x[i] - 1e-9)
        out[k : k + tile] = fits_ & (overlap * (1 + threshold) >= threshold * (low_x[i] + low_y[j]) - 1e-9)
    return out


def _name_groups(levels):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = levels.value
        for batch in batches:
            names = [_group(np.frombuffer(low, np.uint64), size, own) for low, size in zip(batch.column("low").to_pylist(), batch.column("size").to_pylist())]
            yield pa.record_batch([pa.array(names, pa.int64()), *(batch.column(c) for c in ("class", "size", "bitmap"))], names=["grp", "class", "size", "bitmap"])

    return task


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of bounded size, of rows sorted by (grp, size, class); repeated classes are dropped."""
    group, held, total, before = None, [], 0, None

    def tree() -> pa.RecordBatch:
        sizes, classes, bitmaps = zip(*held)
        names = b"".join(classes)
        row = (xxhash.xxh3_128_digest(names), group, len(held), np.array(sizes, np.int32).tobytes(), names, b"".join(bitmaps))
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["tree", "grp", "n", "sizes", "classes", "bitmaps"])

    for batch in batches:
        for g, size, name, bitmap in zip(*(batch.column(c).to_pylist() for c in ("grp", "size", "class", "bitmap"))):
            if name == before:
                continue
            if held and (g != group or len(held) == TREE_CLASSES or total + size > TREE_GRAMS):
                yield tree()
                held, total = [], 0
            group, before = g, name
            held.append((size, name, bitmap))
            total += size
    if held:
        yield tree()


def _trees(signed: DataFrame, levels) -> DataFrame:
    classes = signed.where("bitmap is not null").select("low", "size", "class", "bitmap").mapInArrow(_name_groups(levels), "grp bigint, class binary, size int, bitmap binary")
    classes = stored(classes, "classes")
    large = stored(classes.groupBy("grp").count().where(F.col("count") > GROUP_CLASSES).select("grp", F.ceil(F.col("count") / GROUP_CLASSES).alias("parts")), "large")
    salted = classes.join(bounded_broadcast(large, 24), "grp", "left").withColumn("salt", F.pmod(F.xxhash64("class"), F.coalesce("parts", F.lit(1))))
    return stored(salted.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "size", "class").select("grp", "size", "class", "bitmap").mapInArrow(_plant, TREES), "trees")


def _tree_pairs(trees: DataFrame, group_pairs: DataFrame) -> DataFrame:
    """home, guest and part: pairs of trees of paired groups, and of one group; part spreads the partners of one tree."""
    heads = trees.select("tree", "grp", "n")
    side = lambda s: heads.select(F.col("tree").alias(f"tree_{s}"), F.col("grp").alias(s), F.col("n").alias(f"n_{s}"))
    across = group_pairs.join(side("a"), "a").join(side("b"), "b")
    within = side("a").join(side("b"), F.col("a") == F.col("b")).where("tree_a < tree_b or (tree_a = tree_b and n_a > 1)")
    both = across.select("tree_a", "n_a", "tree_b", "n_b").unionByName(within.select("tree_a", "n_a", "tree_b", "n_b"))
    swap = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("tree_a") > F.col("tree_b")))
    pairs = stored(both.select(F.when(swap, F.col("tree_b")).otherwise(F.col("tree_a")).alias("home"), F.when(swap, F.col("tree_a")).otherwise(F.col("tree_b")).alias("guest")), "tree_pairs")
    hot = stored(pairs.groupBy("home").count().where(F.col("count") > PARTNERS).select("home", F.ceil(F.col("count") / PARTNERS).alias("parts")), "hot")
    return pairs.join(bounded_broadcast(hot, 48), "home", "left").select("home", F.pmod(F.xxhash64("guest"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "guest")


def _walk(threshold: float):
    """Rows sorted by (home, part, guest), the home's own first with an empty guest; out: the candidates of each pair of trees."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = None
        for batch in batches:
            names, guests = batch.column("home").to_pylist(), batch.column("guest").to_pylist()
            parts, groups = batch.column("part").to_pylist(), batch.column("grp").to_pylist()
            sizes, classes, bitmaps = (batch.column(c).to_pylist() for c in ("sizes", "classes", "bitmaps"))
            out: list[tuple] = []
            k = 0
            while k < len(names):
                if not guests[k]:
                    home = _loaded(sizes[k], classes[k], bitmaps[k])
                    k += 1
                    continue
                # Guests of the same home and bitmap width are walked as one tree.
                end, total = k, 0
                wide = width(groups[k] & 255)
                own = guests[k] == names[k]
                while end < len(names) and guests[end] and names[end] == names[k] and parts[end] == parts[k] and width(groups[end] & 255) == wide and total < 4 * TREE_CLASSES and (end == k or not own and guests[end] != names[k]):
                    total += len(sizes[end] or b"") // 4
                    end += 1
                if own:
                    a, b = traverse(home[0], home[0], threshold, True)
                    _keep(out, names[k], parts[k], guests[k], a, b, home[1], home[1])
                else:
                    tree, ids = _loaded(b"".join(sizes[k:end]), b"".join(classes[k:end]), b"".join(bitmaps[k:end]))
                    a, b = traverse(home[0], tree, threshold)
                    at = np.cumsum([0] + [len(s) // 4 for s in sizes[k:end]])
                    which = np.searchsorted(at, b, "right") - 1
                    for w in np.unique(which).tolist():
                        i = which == w
                        _keep(out, names[k], parts[k], guests[k + w], a[i], b[i] - at[w], home[1], ids[at[w] : at[w + 1]])
                k = end
            if out:
                need = pa.list_(pa.struct([("idx", pa.int32()), ("class", pa.binary())]))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.binary(), pa.binary(), need, need))], names=["home", "part", "guest", "pairs", "need_home", "need_guest"])

    return task


def _loaded(sizes: bytes, classes: bytes, bitmaps: bytes) -> tuple[Tree, list[bytes]]:
    own = np.frombuffer(sizes, np.int32).astype(np.int64)
    return Tree(own, np.frombuffer(bitmaps, np.uint64).reshape(len(own), -1)), [classes[i : i + 16] for i in range(0, len(classes), 16)]


def _keep(out: list, home: bytes, part: int, guest: bytes, a: np.ndarray, b: np.ndarray, own: list[bytes], theirs: list[bytes]) -> None:
    if not len(a):
        return
    first, second = (np.unique(np.concatenate([a, b])), a[:0]) if home == guest else (np.unique(a), np.unique(b))
    out.append((home, part, guest, np.concatenate([a, b]).astype(np.int32).tobytes(), [{"idx": i, "class": own[i]} for i in first.tolist()], [{"idx": i, "class": theirs[i]} for i in second.tolist()]))


# ---- verification --------------------------------------------------------------------------------------------------


def _verify(threshold: float, report):
    """Rows sorted by (home, part, guest, idx): the home's sets with an empty guest, then for each guest the pairs at -1 and its sets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, pairs, own = None, {}, None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if pairs is None:
                return
            a, b = np.frombuffer(pairs, np.int32).reshape(2, -1)
            left, right = home, own if key[2] != key[0] else home
            i, j = np.unique(a), np.unique(b)
            sets = [left[k][1] for k in i.tolist()] + [right[k][1] for k in j.tolist()]
            x, y = np.searchsorted(i, a), np.searchsorted(j, b) + len(i)
            overlap = _overlaps(sets, x, y)
            size = np.array([len(s) for s in sets])
            jaccard = overlap / (size[x] + size[y] - overlap)
            good = jaccard >= threshold
            if good.any():
                names = np.array([left[k][0] for k in i.tolist()] + [right[k][0] for k in j.tolist()], object)
                yield report(names, x[good], y[good], jaccard[good])

        for batch in batches:
            for h, p, g, idx, name, payload in zip(*(batch.column(c).to_pylist() for c in ("home", "part", "guest", "idx", "class", "payload"))):
                if key != (h, p, g):
                    yield from done()
                    if key is None or key[:2] != (h, p):
                        home = {}
                    key, pairs, own = (h, p, g), None, {}
                if idx < 0:
                    pairs = payload
                elif g:
                    own[idx] = (name, np.frombuffer(payload, np.uint64))
                else:
                    home[idx] = (name, np.frombuffer(payload, np.uint64))
        yield from done()

    return task


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many n-grams the sets of each pair share: products of 0/1 rows over the n-grams that more than one set has."""
    if len(a) <= 4:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    width = int((count > 1).sum())
    column, row = (np.cumsum(count > 1) - 1)[column[shared]], row[shared]
    out = np.zeros(len(a), np.int64)
    # In tiles of rows against rows, and of columns, each of bounded size.
    tile = 512
    at = np.searchsorted(row, np.arange(len(sets) + 1))
    tiles = len(sets) // tile + 1
    place = (a // tile).astype(np.int64) * tiles + b // tile
    order = np.argsort(place, kind="stable")
    cuts = bounds(place[order])
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        pick = order[s:e]
        p, q = a[pick[0]] // tile * tile, b[pick[0]] // tile * tile
        for c in range(0, width, step := CELLS // tile):
            left, right = (_dense(row, column, at, r, min(r + tile, len(sets)), c, min(c + step, width)) for r in (p, q))
            out[pick] += (left @ right.T)[a[pick] - p, b[pick] - q].astype(np.int64)
    return out


def _dense(row, column, at, r0, r1, c0, c1) -> np.ndarray:
    x = np.zeros((r1 - r0, c1 - c0), np.float32)
    r, c = row[at[r0] : at[r1]], column[at[r0] : at[r1]]
    inside = (c >= c0) & (c < c1)
    x[r[inside] - r0, c[inside] - c0] = 1
    return x


def _all(names, x, y, jaccard) -> pa.RecordBatch:
    """Every pair."""
    return pa.record_batch([pa.array(names[x], pa.binary()), pa.array(names[y], pa.binary()), jaccard], names=["left", "right", "jaccard"])


def _forest(names, x, y, jaccard) -> pa.RecordBatch:
    """Pairs that connect what all the pairs do, fewer than there are classes: each class with the least of its component."""
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    i = np.flatnonzero(label != np.arange(len(names)))
    return pa.record_batch([pa.array(names[label[i]], pa.binary()), pa.array(names[i], pa.binary()), np.ones(len(i))], names=["left", "right", "jaccard"])


def _tally(names, x, y, jaccard) -> pa.RecordBatch:
    """How many pairs each class is in, and its largest Jaccard index."""
    links = np.bincount(np.concatenate([x, y]), minlength=len(names))
    best = np.zeros(len(names))
    np.maximum.at(best, x, jaccard)
    np.maximum.at(best, y, jaccard)
    i = np.flatnonzero(links)
    return pa.record_batch([pa.array(names[i], pa.binary()), links[i].astype(np.int64), best[i]], names=["class", "links", "best"])


# ---- the plan ------------------------------------------------------------------------------------------------------


def _whole(n: int):
    """Class and set of each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = [s for s in _sets(batch, n) if len(s)]
            if sets:
                yield pa.record_batch([pa.array(map(_class, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "grams"])

    return task


def _doc_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text)


def _read(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    own = F.col(f"`{id_col}`").cast("bigint")
    return docs.select(own.alias("id"), _doc_key(own, F.col(f"`{text}`")).alias("doc_key"), F.lower(f"`{text}`").alias("text"))


def _signed(rows: DataFrame, n: int) -> DataFrame:
    return stored(rows.mapInArrow(_sign(n), SIGNED), "signed")


def _verified(rows: DataFrame, signed: DataFrame, n: int, threshold: float, report, schema: str) -> DataFrame:
    """What ``report`` says of the pairs of classes that reach the threshold."""
    levels = rows.sparkSession.sparkContext.broadcast(_levels(signed))  # COUNTERS bytes
    trees = _trees(signed, levels)
    pairs = stored(_tree_pairs(trees, _group_pairs(rows, levels, n, threshold)), "walks")
    blobs = trees.select("tree", "grp", "sizes", "classes", "bitmaps")
    no_guest = F.unhex(F.lit(""))
    homes = pairs.select("home", "part").distinct().join(blobs, F.col("home") == F.col("tree")).withColumn("guest", no_guest).drop("tree")
    guests = pairs.where("guest <> home").join(blobs, F.col("guest") == F.col("tree")).drop("tree")
    selves = pairs.where("guest = home").join(trees.select("tree", "grp"), F.col("guest") == F.col("tree")).drop("tree")
    load = homes.unionByName(guests).unionByName(selves, allowMissingColumns=True)
    load = load.repartition("home", "part").sortWithinPartitions("home", "part", "guest").select("home", "part", "guest", "grp", "sizes", "classes", "bitmaps")
    found = stored(load.mapInArrow(_walk(threshold), FOUND), "candidates")

    at = lambda side, guest: found.select("home", "part", guest.alias("guest"), F.explode(f"need_{side}").alias("n")).select("home", "part", "guest", "n.idx", "n.class")
    wanted = at("home", no_guest).distinct().unionByName(at("guest", F.col("guest")))
    # One document of each class is read again.
    needed = wanted.select("class").distinct().join(signed.where("bitmap is not null").select("class", "id", "doc_key"), "class").groupBy("class").agg(F.min_by("doc_key", F.struct("id", "doc_key")).alias("doc_key"))
    needed = stored(needed.select("doc_key").distinct(), "needed")
    sets = rows.join(bounded_broadcast(needed, 16), "doc_key", "left_semi").select("text").mapInArrow(_whole(n), "class binary, grams binary").dropDuplicates(["class"])
    sets = wanted.join(sets, "class").select("home", "part", "guest", "idx", "class", F.col("grams").alias("payload"))
    tasks = sets.unionByName(found.select("home", "part", "guest", F.lit(-1).alias("idx"), F.lit(None).cast("binary").alias("class"), F.col("pairs").alias("payload")))
    tasks = tasks.repartition("home", "part").sortWithinPartitions("home", "part", "guest", "idx")
    return tasks.mapInArrow(_verify(threshold, report), schema)


def _members(signed: DataFrame) -> DataFrame:
    return signed.where("class is not null").groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))


def similar(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document with a partner, that is, one whose n-gram set is the same or reaches the threshold.

    class_id is the smallest id among the documents with its set, and copies their number; links is how many other sets
    its own reaches the threshold with, and best the largest of these Jaccard indices (null where there is none).
    """
    rows = _read(docs, text, id_col)
    signed = _signed(rows, n)
    tally = _verified(rows, signed, n, threshold, _tally, "class binary, links bigint, best double")
    tally = tally.groupBy("class").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    classes = _members(signed).join(tally, "class", "left").where("copies > 1 or links > 0")
    own = signed.where("class is not null").select("class", F.col("id").alias(id_col))
    return own.join(classes, "class").select(id_col, "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), "best")


def similar_pairs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """left_id < right_id and jaccard: a row for each two different sets that reach the threshold, by their classes' ids.

    Its rows grow with the square of a cluster of near copies; ``similar`` counts them.
    """
    rows = _read(docs, text, id_col)
    signed = _signed(rows, n)
    pairs = _verified(rows, signed, n, threshold, _all, "left binary, right binary, jaccard double")
    ids = _members(signed).select("class", "class_id")
    both = pairs.join(ids.select(F.col("class").alias("left"), F.col("class_id").alias("a")), "left").join(ids.select(F.col("class").alias("right"), F.col("class_id").alias("b")), "right")
    swap = F.coalesce(F.col("b") < F.col("a"), F.col("a").isNull())
    return both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("left_id"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("right_id"), "jaccard")


def groups(pairs: DataFrame) -> DataFrame:
    """Connected components of pairs (left, right): node and root, the least node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to the least node known nearby; components
    of any shape shrink to stars in a number of rounds that grows with the logarithm of their size.
    """
    edges = stored(pairs.select(F.greatest("left", "right").alias("u"), F.least("left", "right").alias("v")).where("u <> v").distinct(), "edges")
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.groupBy("u").agg(F.min("v").alias("m"))
        linked = both.join(large, "u").select(F.col("v"), F.least("u", "m").alias("m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = linked.unionByName(large.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = linked.groupBy("u").agg(F.min("v").alias("m"))
        small = linked.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, before = edges, known
        edges = stored(small, "edges")
        discard(old)
        known = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if known == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def drop_near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of which no pair connects them to one with a smaller id: one of each group stays.

    Documents without n-grams stay. Of repeated rows of the document that stays, one does.
    """
    rows = _read(docs, text, id_col)
    signed = _signed(rows, n)
    pairs = stored(_verified(rows, signed, n, threshold, _forest, "left binary, right binary, jaccard double").select("left", "right"), "pairs")
    own = signed.where("class is not null").select("class", "id", "doc_key")
    grouped = own.join(groups(pairs).withColumnRenamed("node", "class"), "class", "left").select("id", "doc_key", F.coalesce("root", "class").alias("root"))
    one = grouped.groupBy("root", "id", "doc_key").count()
    order = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "doc_key")
    ruled = stored(one.withColumn("k", F.row_number().over(order)).where("k > 1 OR count > 1").select(F.col("doc_key").alias("ruled_key"), (F.col("k") == 1).alias("first")), "ruled")
    body = packed(docs).select("row", _doc_key(F.col(f"row.`{id_col}`").cast("bigint"), F.col(f"row.`{text}`")).alias("doc_key"))
    free = body.join(bounded_broadcast(ruled, 24), F.col("doc_key") == F.col("ruled_key"), "left_anti").select("row")
    again = ruled.where("first")
    if again.isEmpty():  # no row is repeated: the table is read once
        return free.select("row.*")
    repeated = body.join(bounded_broadcast(again, 24), F.col("doc_key") == F.col("ruled_key"), "left_semi")
    once = repeated.withColumn("k", F.row_number().over(Window.partitionBy("doc_key").orderBy("doc_key"))).where("k = 1").select("row")
    return free.unionByName(once).select("row.*")


#: Brute force over strings: every pair of classes that shares an n-gram.
ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
 g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
   ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS gs FROM w WHERE len(ws) > 0),
 c AS (SELECT list(doc_id) AS ids, min(doc_id) AS class_id, count(*) AS copies, gs FROM g GROUP BY gs),
 e AS (SELECT class_id AS first, len(gs) AS n, unnest(gs) AS gram FROM c),
 p AS (SELECT a.first AS a, b.first AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.gram = b.gram AND a.first < b.first GROUP BY ALL),
 j AS (SELECT a, b, c / (na + nb - c) AS jaccard FROM p WHERE c / (na + nb - c) >= 0.6),
 l AS (SELECT class_id, count(*) AS links, max(jaccard) AS best FROM (SELECT a AS class_id, jaccard FROM j UNION ALL SELECT b, jaccard FROM j) GROUP BY class_id)
SELECT unnest(ids) AS doc_id, class_id, copies, coalesce(links, 0) AS links, best FROM c LEFT JOIN l USING (class_id) WHERE copies > 1 OR links > 0
"""
