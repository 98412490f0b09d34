"""Suffix-array dedup by distributed prefix doubling: passages of at least ``threshold`` words that occur more than once.

Texts are suffixes over words. The rank of a position after step h orders it by its first h words; ranks of length 2h are
found by sorting the pairs (rank at i, rank at i + h). Ranks start as 64-bit codes of the first ``seed`` words; each round
splits the pairs by rank range into buckets, sorts each bucket, gives equal pairs one rank, and sends ranks back to the
texts. A position whose rank is unique leaves; rounds end when the compared length is the threshold (the last offset is
chosen so that it is met exactly).

Only positions that can matter enter. Of each window of ``threshold`` words the least code of half as many is an anchor;
equal windows have equal anchors, so a window can be repeated only if its anchor is, and only windows around repeated
anchors are ranked. Texts that are equal as a whole are ranked once. Texts travel in chunks, and a chunk sends each
different pair once, with the first of its places and whether it has others, so that a passage that a third of all
documents share takes a row for each chunk, not for each document. Nothing is sampled and no count of copies is capped.

A position is a copy if its window occurred before, in the order of (doc_id, position); else, if it occurs again, it is the
original. Runs of positions of one kind make a span. Defined results:

* words are runs of letters and digits, lower-cased; null, empty and short texts (fewer words than the threshold) have no
  spans; texts may be of any length;
* repeated rows are occurrences each; ids are integers below 2^63 - 1; a null doc_id comes last; an empty table gives an
  empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, bounds, sliced, stored
from .tokens import NEVER, grams, leaves, raw, sliding, words

THRESHOLD = 50
SEED = 7
#: Positions that one bucket sorts.
BUCKET = 250_000
NO_ID = (1 << 63) - 1
WORD_RUNS = "regexp_count(lower(text), r'[a-z0-9\\x{80}-\\x{10FFFF}]+')"

CHUNK = "chunk bigint, owners binary, copies binary, lengths binary, ends binary, pos binary, final binary, hi binary, lo binary"
SENT = "bucket bigint, chunk bigint, n bigint, idx binary, many binary, hi binary, lo binary, owner binary, pos binary"
REPLY = "chunk bigint, idx binary, label binary"
SPANS = "doc_id bigint, start_word bigint, end_word bigint, is_copy boolean"


# ---- anchors -------------------------------------------------------------------------------------------------------


def _anchors(threshold: int):
    """Rows (code, text_key, pos) of each text's anchors."""
    size = threshold // 2
    width = threshold - size + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, offs = raw(batch.column("text"))
            _, _, hashes, at = words(data, offs)
            codes = grams(hashes, at, size)
            if len(codes) < threshold:
                continue
            least = sliding(codes, width)
            least[leaves(at, threshold)[: len(least)]] = 0  # windows that leave the text
            pad = np.zeros(width - 1, np.uint64)
            index = np.flatnonzero((sliding(np.concatenate([pad, least, pad]), width, np.maximum) == codes) & (codes != NEVER))
            if len(index):
                text = np.searchsorted(at, index, "right") - 1
                keys = batch.column("text_key").to_numpy()
                yield pa.record_batch([codes[index].view(np.int64), keys[text], (index - at[text]).astype(np.int32)], names=["code", "text_key", "pos"])

    return task


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (code, text_key, pos), each distinct one whose code another distinct one has.

    A row is judged by its neighbours alone, so a code may have any number of rows; one row is held between batches.
    """
    held = None  # the last distinct row, and whether it is known to be repeated
    for batch in batches:
        if not batch.num_rows:
            continue
        c, k, p = (batch.column(x).to_numpy() for x in ("code", "text_key", "pos"))
        if held is not None:
            c, k, p = np.concatenate([[held[0]], c]), np.concatenate([[held[1]], k]), np.concatenate([[held[2]], p])
        fresh = np.ones(len(c), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])
        c, k, p = c[fresh], k[fresh], p[fresh]
        same = c[1:] == c[:-1]
        again = np.zeros(len(c), bool)
        again[1:] |= same
        again[:-1] |= same
        if held is not None:
            again[0] |= held[3]
        held = (c[-1], k[-1], p[-1], again[-1])
        out = np.flatnonzero(again[:-1])
        if len(out):
            yield pa.record_batch([k[out], p[out]], names=["text_key", "pos"])
    if held is not None and held[3]:
        yield pa.record_batch([np.array([held[1]], np.int64), np.array([held[2]], np.int32)], names=["text_key", "pos"])


# ---- ranks ---------------------------------------------------------------------------------------------------------


def _seeds(threshold: int, seed: int):
    """Chunks of texts with the positions to rank; hi and lo: codes of the seed words at each and further on."""
    size = threshold // 2
    offsets = np.diff(_lengths(threshold, seed)).tolist()  # how far on each round looks

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, offs = raw(batch.column("text"))
            _, _, hashes, at = words(data, offs)
            total, lengths = len(hashes), np.diff(at)
            anchors = batch.column("anchors")
            counts = np.array([len(x) if x.is_valid else 0 for x in anchors], np.int64)
            flat = anchors.flatten().to_numpy().astype(np.int64) + np.repeat(at[:-1], counts)
            # Windows that hold an anchor begin up to threshold - size words before it and end within the text.
            edge = np.zeros(total + 1, np.int64)
            ends = np.repeat(at[1:], counts)
            begins = np.maximum(flat - (threshold - size), np.repeat(at[:-1], counts))
            flat, begins = flat[flat < ends], begins[flat < ends]  # two texts of one key: a place of the other one
            np.add.at(edge, begins, 1)
            np.add.at(edge, flat + 1, -1)
            final = (np.cumsum(edge[:-1]) > 0) & ~leaves(at, threshold)
            ranked = final.copy()
            for offset in offsets[:0:-1]:  # the first round looks at codes, which all positions have
                ranked[offset:] |= ranked[:-offset].copy()
            codes = grams(hashes, at, seed)
            items = np.flatnonzero(ranked)
            text = np.searchsorted(at, items, "right") - 1
            yield pa.record_batch(
                [
                    pa.array([xxhash.xxh64_intdigest(b"".join(batch.column("full").to_pylist())) >> 1], pa.int64()),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (batch.column("owner").to_numpy(), batch.column("copies").to_numpy(), lengths.astype(np.int64), np.searchsorted(items, at[1:]).astype(np.int64), (items - at[text]).astype(np.int32), final[items])),
                    pa.array([codes[items].tobytes()], pa.binary()), pa.array([(codes[np.minimum(items + offsets[0], total - 1)] if total else codes).tobytes()], pa.binary()),
                ],
                names=["chunk", "owners", "copies", "lengths", "ends", "pos", "final", "hi", "lo"],
            )

    return task


def _lengths(threshold: int, seed: int) -> list[int]:
    """The compared lengths: seed, then doubled, and the threshold at last."""
    out = [seed]
    while out[-1] < threshold:
        out.append(min(2 * out[-1], threshold))
    return out


#: Bits of a rank that number the pairs of one bucket.
_WITHIN = 32
#: A position without a rank: unique, or too near to the end of its text.
MISSING = NEVER
#: Labels of the last round.
ORIGINAL, COPY = np.uint64(1), np.uint64(2)


class _Pairs:
    """The different pairs of ranks of a chunk: places sorted by pair (and, in the last round, by owner and position)."""

    def __init__(self, row: dict, last: bool) -> None:
        self.hi, self.lo = (np.frombuffer(row[c], np.uint64) for c in ("hi", "lo"))
        keep = (self.hi != MISSING) & (self.lo != MISSING)
        if last:
            keep &= np.frombuffer(row["final"], bool)
            self.pos = np.frombuffer(row["pos"], np.int32)
            self.owner = np.repeat(np.frombuffer(row["owners"], np.int64), np.diff(np.frombuffer(row["ends"], np.int64), prepend=0))
        index = np.flatnonzero(keep)
        hi, lo = self.hi[index], self.lo[index]
        order = index[np.lexsort((index, self.pos[index], self.owner[index], lo, hi) if last else (lo, hi))]
        hi, lo = self.hi[order], self.lo[order]
        starts = np.ones(len(order), bool)
        starts[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        self.order, self.first = order, np.flatnonzero(starts)
        self.count = np.diff(self.first, append=len(order))

    def spread(self, replies: pa.Table, last: bool) -> np.ndarray:
        """The label of each place, from the replies to the pairs, by their numbers."""
        by_pair = np.full(len(self.first), MISSING, np.uint64)
        for idx, label in zip(replies.column("idx").to_pylist(), replies.column("label").to_pylist()):
            by_pair[np.frombuffer(idx, np.uint32)] = np.frombuffer(label, np.uint64)
        out = np.full(len(self.hi), MISSING, np.uint64)
        out[self.order] = np.repeat(by_pair, self.count)
        if last:  # only the first place of a pair can be the original
            rest = np.ones(len(self.order), bool)
            rest[self.first] = False
            rest = self.order[rest]
            out[rest] = np.where(out[rest] == MISSING, MISSING, COPY)
        return out


def _send(buckets: int, first: bool, last: bool):
    """Each chunk's pairs by bucket. Seed codes spread evenly by value, later ranks carry their bucket on top."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = _Pairs(row, last)
                place = pairs.order[pairs.first]
                hi, lo, many = pairs.hi[place], pairs.lo[place], pairs.count > 1
                bucket = ((hi >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) if first else hi >> np.uint64(_WITHIN)
                at = bounds(bucket) if len(bucket) else np.zeros(1, np.int64)  # pairs are sorted by hi, hence by bucket
                out = []
                for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                    own, pos = (pairs.owner[place[s:e]].tobytes(), pairs.pos[place[s:e]].tobytes()) if last else (b"", b"")
                    out.append((int(bucket[s]), row["chunk"], e - s, np.arange(s, e, dtype=np.uint32).tobytes(), many[s:e].tobytes(), hi[s:e].tobytes(), lo[s:e].tobytes(), own, pos))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 3 + (pa.binary(),) * 6)], names=["bucket", "chunk", "n", "idx", "many", "hi", "lo", "owner", "pos"])

    return task


def _rank(last: bool):
    """Sorts one bucket's pairs; equal pairs get one rank, in the order of the pairs. Unique ones get no reply."""

    def group(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in table.column_names if c != "bucket"}
        bucket = table.column("bucket")[0].as_py()
        join = lambda c, t: np.frombuffer(b"".join(col[c]), t)
        hi, lo, index, many = join("hi", np.uint64), join("lo", np.uint64), join("idx", np.uint32), join("many", bool)
        source = np.repeat(np.arange(len(col["n"])), col["n"])
        if last:
            chunk = np.repeat(np.array(col["chunk"], np.int64), col["n"])
            order = np.lexsort((index, chunk, join("pos", np.int32), join("owner", np.int64), lo, hi))
        else:
            order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        starts = np.ones(len(hi), bool)
        starts[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        number = np.cumsum(starts) - 1
        again = (np.bincount(number) > 1) | (np.bincount(number, many[order]) > 0)
        again = again[number]
        if last:
            label = np.where(starts, ORIGINAL, COPY)
        else:
            if bucket >> (63 - _WITHIN) or len(hi) >> _WITHIN:
                raise OverflowError("ranks take more than 64 bits: raise bucket_rows")
            label = np.uint64(bucket << _WITHIN) + np.flatnonzero(starts).astype(np.uint64)[number]
        order, label = order[again], label[again]
        by = np.argsort(source[order], kind="stable")
        order, label = order[by], label[by]
        at = np.searchsorted(source[order], np.arange(len(col["n"]) + 1)).tolist()
        rows = [(col["chunk"][k], index[order[s:e]].tobytes(), label[s:e].tobytes()) for k, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s]
        chunks, idx, labels = zip(*rows) if rows else ((), (), ())
        return pa.table([pa.array(chunks, pa.int64()), pa.array(idx, pa.binary()), pa.array(labels, pa.binary())], names=["chunk", "idx", "label"])

    return group


def _advance(offset: int):
    """A chunk with its new ranks as hi, and as lo those ``offset`` words on."""

    def group(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            pos = np.frombuffer(row["pos"], np.int32).astype(np.int64)
            label = _Pairs(row, False).spread(replies, False)
            text = np.repeat(np.arange(len(row["ends"]) // 8), np.diff(np.frombuffer(row["ends"], np.int64), prepend=0))
            place = (text << 32) + pos  # ascending
            there = np.minimum(np.searchsorted(place, place + offset), max(0, len(place) - 1))
            found = place[there] == place + offset if len(place) else np.zeros(0, bool)
            out.append(row | {"hi": label.tobytes(), "lo": np.where(found, label[there], MISSING).tobytes()})
        return pa.Table.from_pylist(out, chunks.schema)

    return group


def _spans(threshold: int):
    """The spans of each text, for its first document."""

    def group(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        docs, starts, ends, copy = [], [], [], []
        for row in chunks.to_pylist():
            at = np.frombuffer(row["ends"], np.int64)
            pos = np.frombuffer(row["pos"], np.int32)
            label = _Pairs(row, True).spread(replies, True)
            columns = (np.frombuffer(row[c], np.int64).tolist() for c in ("owners", "copies", "lengths"))
            for s, e, owner, copies, length in zip([0, *at[:-1].tolist()], at.tolist(), *columns):
                kind = np.zeros(max(0, length - threshold + 1) + 2, np.int8)  # 1: original, 2: copy; one empty place on either side
                if copies > 1:
                    kind[1:-1] = 1
                known = np.flatnonzero(label[s:e] != MISSING) + s
                kind[pos[known] + 1] = label[known]
                cut = np.flatnonzero(kind[1:] != kind[:-1])
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if kind[a + 1]:
                        docs.append(None if owner == NO_ID else owner)
                        starts.append(a)
                        ends.append(b + threshold - 1)
                        copy.append(bool(kind[a + 1] == 2))
        return pa.table([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(copy, pa.bool_())], names=["doc_id", "start_word", "end_word", "is_copy"])

    return group


# ---- the plan ------------------------------------------------------------------------------------------------------


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def repeated_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, seed: int = SEED, bucket_rows: int = BUCKET) -> DataFrame:
    """Spans [start_word, end_word) of documents made of repeated windows, and whether they are copies of earlier ones."""
    own = docs.where(F.col(f"`{text}`").isNotNull()).select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(f"`{text}`").alias("text"))
    rows = own.select("id", _text_key(F.col("text")).alias("text_key"), "text")
    lower = F.lower("text").alias("text")
    anchors = rows.select("text_key", lower).mapInArrow(_anchors(threshold), "code bigint, text_key bigint, pos int")
    sorted_ = anchors.repartition("code").sortWithinPartitions("code", "text_key", "pos")
    near = stored(sorted_.mapInArrow(_repeated, "text_key bigint, pos int").groupBy("text_key").agg(F.sort_array(F.collect_list("pos")).alias("anchors")), "anchors")
    copied = stored(rows.groupBy("text_key").count().where("count > 1").select("text_key"), "copied")

    # The key finds texts; 128 bits tell them apart, of the few that are left.
    full = F.unhex(F.md5("text")).alias("full")
    needed = stored(near.select("text_key").unionByName(copied).distinct(), "needed")
    texts = rows.join(bounded_broadcast(needed, 16), "text_key", "left_semi").select("id", "text_key", full, "text")
    texts = texts.groupBy("text_key", "full").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    texts = texts.join(near, "text_key", "left").select("full", "owner", "copies", lower, "anchors")
    chunks = stored(texts.mapInArrow(_seeds(threshold, seed), CHUNK), "chunks")
    items = chunks.agg(F.sum(F.octet_length("pos") / 4)).first()[0] or 0
    buckets = max(1, math.ceil(items / bucket_rows))
    lengths = _lengths(threshold, seed)
    for k, length in enumerate(lengths[1:], 1):
        last = length == threshold
        sent = chunks.mapInArrow(_send(buckets, k == 1, last), SENT)
        replies = sent.groupBy("bucket").applyInArrow(_rank(last), REPLY).groupBy("chunk")
        pairs = chunks.groupBy("chunk").cogroup(replies)
        if last:
            spans = pairs.applyInArrow(_spans(threshold), SPANS)
        else:
            chunks = stored(pairs.applyInArrow(_advance(lengths[k + 1] - length), CHUNK), "chunks")

    # The further documents of a text are copies from end to end.
    order = Window.partitionBy("text_key", "full").orderBy("id")
    further = rows.join(bounded_broadcast(copied, 16), "text_key", "left_semi").select("id", "text_key", full, F.expr(WORD_RUNS).cast("bigint").alias("n"))
    # Words are counted above the join: a filter on n before the window would be pushed below it, to all texts.
    further = further.withColumn("k", F.row_number().over(order)).where(f"k > 1 AND n >= {threshold}")
    whole = further.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.lit(0).cast("bigint").alias("start_word"), F.col("n").alias("end_word"), F.lit(True).alias("is_copy"))
    return spans.unionByName(whole)


#: Brute force over strings: all windows of 50 words.
ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
 p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS pos FROM w WHERE len(ws) >= 50),
 h AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + 50], ' ')) AS h FROM p),
 r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS c, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS n FROM h),
 k AS (SELECT doc_id, pos, n > 1 AS is_copy FROM r WHERE c > 1),
 i AS (SELECT doc_id, pos, is_copy, pos - row_number() OVER (PARTITION BY doc_id, is_copy ORDER BY pos) AS g FROM k)
SELECT doc_id, min(pos) AS start_word, max(pos) + 50 AS end_word, is_copy FROM i GROUP BY doc_id, is_copy, g
"""
