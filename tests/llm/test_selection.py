"""Line cleaning, the quality network, mixing and packing."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import lines, mixing, packing, quality, queries

from .conftest import prose

# ---- lines


def test_lines_go_first_then_documents(docs_of):
    good = "A line of prose that ends as it should."
    rows = [
        (1, f"{good}\nHome | About | Contact\n\n  {good} ", "s"), (2, f"{good}\n" + "Home | About | News | Contact us now\n" * 9, "s"), (3, "No end", "s"),
        (4, f"{good}\nAll rights reserved.", None), (5, "spam$$$ words### here%%% now&&&.", "s"), (6, "go go go go go go go go go go go go go go go go go.", "s"),
        (12, f"{good}\n" + "\t" * 100 + "\n \u00a0\r\n", "s"), (13, f"{good}\r\n\t{good}\r\n", "s"), (14, "The bakery sells a cookie and a cup of tea every morning.", "s"), (15, "He studied copyright law for years.", "s"),
        (16, "Alle Rechte vorbehalten.", "s"), (17, "Tous droits réservés.", "s"), (18, "Wir verwenden Cookies.", "s"), (19, "Política de privacidad.", "s"), (20, "We use cookies to serve you.", "s"), (21, "Copyright (c) 2024 by us.", "s"),
        (7, None, "s"), (8, "", "s"), (9, " \n ", "s"), (None, good, "s"), (10, good, "s"), (10, good, "s"), (11, (good + "\n") * 5000, "s"),
    ]
    kept = lines.clean_lines(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    got = {(r.doc_id, r.text if len(r.text) < 1000 else len(r.text), r.n_chars) for r in kept.collect()}
    assert got == {(1, f"{good}\n{good}", 79), (4, good, 39), (None, good, 39), (10, good, 39), (11, 40 * 5000 - 1, 40 * 5000 - 1), (12, good, 39), (13, f"{good}\n{good}", 79), *((i, t, len(t)) for i, t, _ in rows if i in (14, 15))}
    assert kept.where("doc_id = 10").count() == 2


def test_lines_empty(none):
    assert lines.clean_lines(none).count() == 0


def plain_pieces(line):
    """The pieces of a line that lines.py describes, plainly."""
    units = re.findall("[^ ]{1,64} *", line)
    if len(units) <= 256:
        return [line]
    runs = [tuple(units[k : k + 10]) for k in range(len(units) - 9)]
    n = -(-len(units) // 256)
    return [] if len(set(runs)) < 0.25 * len(runs) else ["".join(units[k * len(units) // n : (k + 1) * len(units) // n]) for k in range(n)]


def test_long_lines_lose_what_fails_in_them_and_no_more(docs_of):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    words = [r.choice(vocabulary) for _ in range(150_000)]
    clean = " ".join(words) + "."
    spoilt = [*words[:20_000]]
    spoilt[7_000], spoilt[12_000:12_003] = "spam$$$ more!!!", ["Home", "|", "About | News | Contact"]
    spoilt[3_000:3_003] = ["all rights reserved", "cookie", "click here"]
    spoilt = " ".join(spoilt)
    passage = " ".join(words[:600])
    unspaced = "".join(r.choice("abcdefghijklmnop。") for _ in range(60_000)) + "$$$a$$$" + "x" * 40_000 + "。"
    few = " ".join(words[:256]) + "."
    marked = few + " spam$$$ more!!!"
    want = {1: clean, 2: None, 3: None, 4: None, 5: None, 6: few, 7: None, 8: None}
    for i, line, bad in ((2, spoilt, ("$$$", "Home |")), (5, unspaced, ("$$$",))):
        want[i] = "".join(p for p in plain_pieces(line) if not any(b in p for b in bad)).strip()
        assert 0 < len(line) - len(want[i]) < 0.25 * len(line)
    rows = [
        (1, clean, "s"), (2, spoilt, "s"), (3, f"{passage} " * 40 + "End.", "s"), (4, "go " * 100_000 + "End.", "s"),
        (5, unspaced, "s"), (6, few, "s"), (7, marked, "s"), (8, "Home | About | News " * 5_000, "s"),
    ]
    got = {x.doc_id: x for x in lines.clean_lines(docs_of(rows)).collect()}
    assert {i: x.text for i, x in got.items()} == {i: t for i, t in want.items() if t}
    assert all(x.n_chars == len(x.text) for x in got.values())


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in lines.clean_lines(docs).select("doc_id").collect()}
    rows = labels.collect()
    good, bad = [r.doc_id for r in rows if r.quality == 1], [r.doc_id for r in rows if r.quality == 0]
    assert sum(i in kept for i in good) >= 0.99 * len(good)
    assert sum(i not in kept for i in bad) >= 0.95 * len(bad)


# ---- quality


def test_network_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where(F.xxhash64("doc_id") % 4 != 0)
    net = quality.train(docs, train)
    got = quality.classify(docs, net).join(labels.where(F.xxhash64("doc_id") % 4 == 0), "doc_id").toPandas()
    clean, bad = got[got.quality == 1], got[got.quality == 0]
    assert ((got.probability >= 0.5) == (got.quality == 1)).mean() > 0.94
    assert clean.keep.mean() > 0.98 and (~bad.keep).mean() >= 0.65


def test_chunks_cover_every_byte_and_only_that():
    lengths = [0, 1, 255, 256, 257, 480, 481, 5000]
    data = np.random.default_rng(0).integers(0, 256, sum(lengths)).astype(np.uint8)
    offs = np.concatenate([[0], np.cumsum(lengths)])
    values, doc = quality.Network.chunks(data, offs)
    step = quality.CHUNK - quality.OVERLAP
    for d, n in enumerate(lengths):
        own = values[doc == d]
        seen = np.full(n, -1)
        for k, chunk in enumerate(own):
            inside = chunk[: max(0, n - k * step)]
            seen[k * step : k * step + len(inside)] = inside
            assert (chunk[len(inside) :] == 256).all()
        assert (seen == data[offs[d] : offs[d + 1]]).all()


def test_gradient_by_differences():
    net = quality.Network(3)
    r = np.random.default_rng(1)
    data, offs, y = r.integers(97, 110, 1500).astype(np.uint8), np.array([0, 300, 310, 1500]), np.array([1, 0, 1], np.float32)
    values, doc = net.chunks(data, offs)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    g = net.gradient(values, doc, y)

    def loss():
        p = net.scores(data, offs)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("out", "bias", "filter", "embed"):
        for index in [tuple(int(r.integers(0, n)) if name != "embed" or axis else int(r.integers(97, 110)) for axis, n in enumerate(net.w[name].shape)) for _ in range(6)]:
            old, h = net.w[name][index], 1e-3
            net.w[name][index] = old + h
            up = loss()
            net.w[name][index] = old - h
            down = loss()
            net.w[name][index] = old
            assert abs((up - down) / (2 * h) - g[name][index]) < 0.01 + 0.05 * abs(g[name][index]), (name, index)


def plain_score(net, data: bytes) -> float:
    """The network by loops over chunks, windows and filters."""
    w, step, tops = {k: v.astype(float) for k, v in net.w.items()}, quality.CHUNK - quality.OVERLAP, []
    start = 0
    while True:
        chunk = [*data[start : start + quality.CHUNK]]
        chunk += [256] * (quality.CHUNK - len(chunk))
        features = []
        for f in range(quality.FILTERS):
            best = 0.0
            for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                x = w["bias"][f] + sum(w["embed"][chunk[at + k]][d] * w["filter"][k * quality.DIM + d][f] for k in range(quality.WIDTH) for d in range(quality.DIM))
                best = max(best, x)
            features.append(best)
        tops.append(features)
        if start + quality.CHUNK >= len(data):
            break
        start += step
    both = [sum(c) / len(tops) for c in zip(*tops)] + [max(c) for c in zip(*tops)]
    return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(both, w["out"])) + w["shift"][0])))


def test_scores_against_a_plain_network():
    net, r = quality.Network(4), np.random.default_rng(4)
    net.w["bias"] = r.standard_normal(quality.FILTERS).astype(np.float32)
    texts = [b"x", "Grüße, so kurz.".encode(), bytes(r.integers(32, 127, 256).tolist()), bytes(r.integers(32, 127, 700).tolist())]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    assert np.allclose(net.scores(data, offs), [plain_score(net, t) for t in texts], atol=1e-4)


def test_scores_do_not_depend_on_the_batch(nasty):
    net = quality.Network(2)
    got = {(r.doc_id, round(r.probability, 5)) for r in quality.classify(nasty, net).collect()}
    for r in nasty.select("doc_id", "text").collect():
        b = np.frombuffer((r.text or "").encode(), np.uint8)
        p = round(float(net.scores(b, np.array([0, len(b)]))[0]), 5)
        assert any(i == r.doc_id and abs(q - p) <= 2e-5 for i, q in got)
        assert (r.text or "") != "" or p == 0


def test_training_without_use(spark, nasty, none):
    labels = "doc_id bigint, quality int"
    for rows, want in (([], 0.5), ([(1, 1), (2, 1), (99, 0), (3, None), (None, 0), (6, 0), (7, 0)], 1.0)):
        net = quality.train(nasty, spark.createDataFrame(rows, labels))
        assert net.constant == want
        assert {r.probability for r in quality.classify(nasty, net).collect()} == {want, 0.0}
    assert quality.classify(none, quality.Network()).count() == 0


# ---- mixing


def tokens(text):
    return len((text or "").split())


def test_flight_keeps_totals_and_probabilities():
    r = random.Random(0)
    p, t = [r.uniform(0.05, 0.95) for _ in range(60)], [r.randint(1, 3000) for _ in range(60)]
    hits = np.zeros(60)
    for trial in range(1500):
        flight, rng, chosen = mixing.Flight(), random.Random(trial), []
        for i in range(60):
            chosen += [n for n, c in flight.add(i, p[i], float(t[i]), rng.random()) if c]
        rest = [(u[0], u[1]) for u in flight.units]
        assert len(rest) <= 2
        assert abs(len(chosen) + sum(x for _, x in rest) - sum(p)) < 1e-6
        assert abs(sum(t[i] for i in chosen) + sum(x * t[i] for i, x in rest) - sum(a * b for a, b in zip(p, t))) < 1e-3
        hits[chosen + [n for n, c in flight.land(lambda _: rng.random()) if c]] += 1
    assert np.abs(hits / 1500 - p).max() < 0.06


def sizes(df):
    out = defaultdict(lambda: [0, 0])
    for r in df.select("source", "text").collect():
        out[r.source][0] += 1
        out[r.source][1] += tokens(r.text)
    return out


def fill(totals, weights, budget):
    """Water filling, plainly: raise the level until the budget is met."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(t, mid * weights[s]) for s, t in totals.items()) < budget else (low, mid)
    return {s: min(1.0, low * weights[s] / t) if t else 1.0 for s, t in totals.items()}


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 1.0, "c": 1.0, "tiny": 1.0}, {"a": 1.0, "b": 0.0, "c": 1.0}])
def test_mix_meets_the_weights(docs_of, weights):
    r = random.Random(8)
    rows = [(i, prose(i, r.randint(1, 120)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 120 + ["c"] * 80 + ["tiny"] * 2 + [None] * 40)]
    docs = docs_of(rows)
    before, sample = sizes(docs), mixing.mix(docs, weights)
    assert sample.columns == docs.columns
    w = {s: (t**mixing.WEIGHT_POWER if weights is None else weights.get(s, 0.0)) for s, (_, t) in before.items()}
    p = fill({s: t for s, (_, t) in before.items()}, w, mixing.BUDGET_SHARE * sum(t for _, t in before.values()))
    after = sizes(sample)
    for s, (n, t) in before.items():
        assert abs(after[s][0] - p[s] * n) <= 2.5, s
        assert abs(after[s][1] - p[s] * t) <= 300, s
    assert abs(sum(x for x, _ in after.values()) - sum(p[s] * n for s, (n, _) in before.items())) <= 1.5
    assert {r.doc_id for r in sample.select("doc_id").collect()} == {r.doc_id for r in mixing.mix(docs, weights).select("doc_id").collect()}


class PlainFlight:
    """The cube method with a null space from singular vectors, over units (name, p, tokens) of which three at most are open."""

    def __init__(self):
        self.units, self.chosen = [], []

    def move(self, v, u):
        up = min((1 - p) / x if x > 0 else -p / x for (_, p, _), x in zip(self.units, v) if abs(x) > 1e-12)
        down = min(p / x if x > 0 else (p - 1) / x for (_, p, _), x in zip(self.units, v) if abs(x) > 1e-12)
        step = up if u < down / (up + down) else -down
        moved = [(name, p + step * x, t) for (name, p, t), x in zip(self.units, v)]
        self.chosen += [name for name, p, _ in moved if p >= 1 - 1e-9]
        self.units = [m for m in moved if 1e-9 < m[1] < 1 - 1e-9]

    def add(self, name, p, t, u):
        if p >= 1 - 1e-9:
            self.chosen.append(name)
        elif p > 1e-9:
            self.units.append((name, p, t))
        if len(self.units) == 3:
            (_, _, a), (_, _, b), (_, _, c) = self.units
            if a == b == c:
                return self.move([1, -1, 0], u)
            v = np.linalg.svd(np.array([[1, 1, 1], [a, b, c]], float))[2][2]
            first = next(x for x in (c - b, a - c, b - a) if x)  # the sign of the direction is the operator's
            lead = next(x for x, d in zip(v, (c - b, a - c, b - a)) if d)
            self.move(v * (1 if lead * first > 0 else -1), u)


def plain_mix(rows, seed, share):
    import xxhash

    draw = lambda i, t, s: xxhash.xxh64_intdigest(f"{i}/{float(t)}", s) / 2.0**64
    totals = defaultdict(int)
    for _, t, s in rows:
        totals[s] += tokens(t)
    p = fill(totals, {s: t**mixing.WEIGHT_POWER for s, t in totals.items()}, share * sum(totals.values()))
    chosen, left = [], []
    flights = defaultdict(PlainFlight)
    for i, t, s in rows:
        flights[s].add(i, p[s], tokens(t), draw(i, tokens(t), seed))
    for s, flight in sorted(flights.items()):
        chosen += flight.chosen
        second = PlainFlight()
        for i, q, t in sorted(flight.units, key=lambda x: (str(x[0]), x[2])):
            second.add(i, q, t, draw(i, t, seed + 1))
        chosen += second.chosen
        left += second.units
    last = PlainFlight()
    for i, q, t in sorted(left, key=lambda x: (str(x[0]), x[2])):
        last.add(i, q, t, draw(i, t, seed + 2))
    while len(last.units) > 1:
        i, _, t = last.units[0]
        last.move([1, -1, 0][: len(last.units)], draw(i, t, seed + 3))
    chosen += last.chosen + [i for i, q, t in last.units if draw(i, t, seed + 3) < q]
    return sorted(chosen)


@pytest.mark.parametrize("seed", [17, 18, 19])
def test_mix_against_a_plain_cube(docs_of, seed):
    r = random.Random(seed)
    rows = [(i, prose(i, r.choice([1, 5, 5, 5, 30, 31, 90])), s) for i, s in enumerate(r.choices("abcd", [8, 4, 2, 1], k=260))]
    got = mixing.mix(docs_of(rows).coalesce(1), seed=seed).select("doc_id").collect()
    assert sorted(x.doc_id for x in got) == plain_mix(rows, seed, mixing.BUDGET_SHARE)


def test_mix_without_broadcast(spark, docs_of, monkeypatch):
    rows = [(i, prose(i, 1 + i % 40), "abc"[i % 3]) for i in range(90)]
    want = sorted(x.doc_id for x in mixing.mix(docs_of(rows).coalesce(1), budget_share=1.0).select("doc_id").collect())
    monkeypatch.setattr(mixing, "bounded_broadcast", lambda df, size: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(x.doc_id for x in mixing.mix(docs_of(rows), budget_share=1.0).select("doc_id").collect()) == want == list(range(90))
        n = len(mixing.mix(docs_of(rows)).select("doc_id").collect())
        assert abs(n - len(plain_mix(rows, mixing.SEED, mixing.BUDGET_SHARE))) <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mix_nasty_and_empty(nasty, none):
    rows = Counter((r.doc_id, r.source, (r.text or "")[:40]) for r in nasty.collect())
    got = Counter((r.doc_id, r.source, (r.text or "")[:40]) for r in mixing.mix(nasty).collect())
    assert got and not got - rows
    everything = Counter((r.doc_id, r.source, (r.text or "")[:40]) for r in mixing.mix(nasty, budget_share=1.0).collect())
    assert sum(everything.values()) == sum(rows.values())
    assert mixing.mix(none).count() == 0


# ---- packing


def plain_best_fit(sizes_, capacity):
    """Bins as lists of places; among the open bins that an item fits best, the one that was filled to that level last."""
    bins, spaces, since = [], [], []
    for i, size in enumerate(sizes_):
        fits = [k for k, space in enumerate(spaces) if space >= size]
        if fits:
            k = min(fits, key=lambda k: (spaces[k], -since[k]))
            bins[k].append(i)
            spaces[k] -= size
        else:
            k = len(bins)
            bins.append([i])
            spaces.append(capacity - size)
            since.append(0)
        since[k] = i
    return bins


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_is_best_fit(sizes_):
    assert packing.best_fit(sizes_, 20) == plain_best_fit(sizes_, 20)


def plain_pack(rows, capacity, leaf_items, fan_in):
    """The whole hierarchy, plainly: rows in the order of their numbers; sets of bins as sorted pieces."""
    import xxhash

    def node(key, nodes):
        h = xxhash.xxh64_intdigest((key & (1 << 64) - 1).to_bytes(8, "little"), 42)
        return (h - (1 << 64) if h >> 63 else h) % nodes

    out, items, number = [], [], 0
    for i, t in rows:
        n = tokens(t)
        for start in range(0, n, capacity):
            piece = (i, start, min(capacity, n - start))
            if piece[2] == capacity:
                out.append([piece])
            else:
                items.append((number, [piece], piece[2]))
            number += 1
    before, nodes, level = len(items), max(1, -(-len(items) // leaf_items)), 0
    while True:
        done, under = [], []
        for own in range(nodes):
            mine = sorted((x for x in items if node(x[0], nodes) == own), key=lambda x: (-x[2], x[1][0][0] is None, x[1][0][0] or 0, x[1][0][1], x[0]))
            for k, b in enumerate(plain_best_fit([x[2] for x in mine], capacity)):
                pieces = [p for i in b for p in mine[i][1]]
                fill_ = sum(p[2] for p in pieces)
                full = nodes == 1 or fill_ >= packing.FULL[min(level, 4)] * capacity
                (done if full else under).append(((level << 58) | (own << 26) | k, pieces, fill_))
        out += [pieces for _, pieces, _ in done]
        wide = max(-(-nodes // fan_in), -(-len(under) // (fan_in * leaf_items)))
        if not under or (level and wide >= nodes and len(under) > before * (1 - 1 / packing.STALLED)):
            return sorted((sorted(x, key=repr) for x in out + [pieces for _, pieces, _ in under]), key=repr)
        least = min(f for *_, f in under)
        out += [pieces for _, pieces, f in under if capacity - f < least]
        items = [x for x in under if capacity - x[2] >= least]
        nodes, before, level = wide, len(under), level + 1


@pytest.mark.parametrize(("leaf", "fan_in", "choices"), [(10, 3, [1, 3, 9, 20, 31, 32, 33, 64, 200]), (40, 2, [17, 18, 19, 3]), (7, 4, [17, 17, 17, 2]), (1000, 2, [5, 40])])
def test_the_whole_hierarchy_against_a_plain_version(docs_of, leaf, fan_in, choices):
    r = random.Random(leaf)
    rows = [(i if i % 5 else None, "w " * r.choice(choices)) for i in range(300)]
    bins = packing.pack(docs_of([(i, t, "s") for i, t in rows]).coalesce(1), capacity=32, leaf_items=leaf, fan_in=fan_in).collect()
    got = sorted((sorted(zip(b.doc_ids, b.starts, b.lengths), key=repr) for b in bins), key=repr)
    assert got == plain_pack(rows, 32, leaf, fan_in)


def covered(bins, capacity):
    out = defaultdict(list)
    ids = [b.bin_id for b in bins]
    assert len(ids) == len(set(ids))
    for b in bins:
        assert sum(b.lengths) == b.tokens <= capacity and len(b.doc_ids) == len(b.starts) == len(b.lengths)
        for i, s, n in zip(b.doc_ids, b.starts, b.lengths):
            out[i].append((s, n))
    return out


@pytest.mark.parametrize("leaf", [10, 50, 100_000])
def test_pack_holds_every_token_once(docs_of, leaf):
    r = random.Random(2)
    rows = [(i, "w " * r.choice([1, 3, 9, 20, 31, 32, 33, 64, 200, 1000]), "s") for i in range(400)]
    bins = packing.pack(docs_of(rows), capacity=32, leaf_items=leaf, fan_in=3).collect()
    own = covered(bins, 32)
    for i, t, _ in rows:
        at = 0
        for s, n in sorted(own[i]):
            assert s == at
            at += n
        assert at == tokens(t)
    total = sum(tokens(t) for _, t, _ in rows)
    assert len(bins) <= 1.1 * total / 32 + 3


def test_pack_nasty_and_empty(nasty, none):
    own = covered(packing.pack(nasty).collect(), packing.CAPACITY)
    want = defaultdict(int)
    for r in nasty.collect():
        want[r.doc_id] += tokens(r.text)
    assert {i: sum(n for _, n in p) for i, p in own.items()} == {i: n for i, n in want.items() if n}
    assert packing.pack(none).count() == 0


def test_no_bin_that_could_be_filled_leaves_before_the_root(spark):
    """Leaves of two documents of 0.56 or 0.4 bins: over 4,096 underfull bins go up, and the root alone emits any that another would fit."""
    docs = spark.range(14_000).selectExpr("id AS doc_id", "repeat('w ', if(id % 7 = 0, 13, 18)) AS text")
    bins = packing.pack(docs, capacity=32, leaf_items=2, fan_in=10_000).collect()
    assert len(covered(bins, 32)) == 14_000
    early = [b.tokens for b in bins if b.bin_id >> 58 == 0]
    assert len(bins) - len(early) > 4_096 and all(32 - t < 13 for t in early)
    assert sum(b.tokens == 18 for b in bins) == sum(n == 18 for b in bins for n in b.lengths) - sum(b.tokens == 31 for b in bins)
    assert sum(b.tokens == 13 for b in bins) <= 1


def test_many_rows_without_an_id_are_spread(spark):
    docs = spark.range(4_000).selectExpr("cast(null AS bigint) AS doc_id", "repeat('w ', 5) AS text")
    bins = packing.pack(docs, capacity=32, leaf_items=200).collect()
    assert sum(b.tokens for b in bins) == 20_000 and len(bins) <= 670
    leaves = {(b.bin_id >> 26) % (1 << 32) for b in bins if b.bin_id >= 0 and b.bin_id >> 58 == 0}
    assert len(leaves) > 10


def test_op10_against_sql(compare):
    compare(queries.QUERIES["op10_line_cleaning"], queries.ORACLES["op10_line_cleaning"])
