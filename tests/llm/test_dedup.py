"""Exact, n-gram and suffix dedup against plain versions, on nulls, empty and long texts, ties and repeated rows."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import exact, jaccard, queries, repeats

from .conftest import prose


def words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def ordered(ids):
    return sorted(ids, key=lambda i: (i is None, i or 0))


# ---- exact


def test_exact_copies(nasty):
    got = sorted(((r.doc_id, r.kept_id, r.copies) for r in exact.exact_copies(nasty).collect()), key=repr)
    assert got == sorted([(1, 1, 4), (2, 1, 4), (2, 1, 4), (None, 1, 4), (7, 7, 2), (8, 7, 2), (12, 12, 2), (12, 12, 2)], key=repr)


def test_exact_drop_keeps_one_row_and_all_columns(nasty):
    kept = exact.drop_exact_copies(nasty)
    assert kept.columns == nasty.columns
    assert ordered(r.doc_id for r in kept.select("doc_id").collect()) == ordered([1, 3, 4, 5, 6, None, 7, 9, 10, 11, 12, 13])
    assert {r["ID"] for r in kept.select("ID").collect()} == {"own ID"}


def test_exact_same_length_and_prefix(docs_of):
    a, b = "x" * 500 + "a", "x" * 500 + "b"
    assert {r.doc_id for r in exact.drop_exact_copies(docs_of([(1, a, "s"), (2, b, "s"), (3, b, "s")])).collect()} == {1, 2}


def test_exact_beyond_the_broadcast_bound(nasty, none, monkeypatch):
    small, kept = exact.exact_copies(nasty).count(), exact.drop_exact_copies(nasty).select("doc_id", "text").collect()
    monkeypatch.setattr(exact, "fits", lambda df, size: False)
    assert exact.exact_copies(nasty).count() == small == 8
    assert sorted(map(repr, exact.drop_exact_copies(nasty).select("doc_id", "text").collect())) == sorted(map(repr, kept))
    assert exact.drop_exact_copies(none).count() == 0
    plan = exact.drop_exact_copies(nasty)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the rows once, and the keys unless Spark finds them small


def test_exact_empty(none):
    assert exact.exact_copies(none).count() == exact.drop_exact_copies(none).count() == 0


# ---- n-grams


def gram_sets(rows, n=3):
    classes = defaultdict(list)
    for i, t in rows:
        w = words(t)
        if w:
            classes[frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])].append(i)
    return [(s, ordered(ids)) for s, ids in classes.items()]


def brute_pairs(rows, n=3, threshold=0.6):
    """Of classes, by their places among them; an index of n-grams spares pairs that have none in common."""
    items, having, out = gram_sets(rows, n), defaultdict(list), {}
    for k, (s, _) in enumerate(items):
        common = defaultdict(int)
        for gram in s:
            for other in having[gram]:
                common[other] += 1
            having[gram].append(k)
        for other, c in common.items():
            j = c / (len(s) + len(items[other][0]) - c)
            if j >= threshold:
                out[other, k] = j
    return items, out


def brute_similar(rows, threshold=0.6):
    items, pairs = brute_pairs(rows, threshold=threshold)
    links = defaultdict(list)
    for (a, b), j in pairs.items():
        links[a].append(j)
        links[b].append(j)
    return sorted(((i, ids[0], len(ids), len(links[k]), max(links[k], default=None)) for k, (_, ids) in enumerate(items) if len(ids) > 1 or links[k] for i in ids), key=repr)


def linked(df):
    return sorted(((r.doc_id, r.class_id, r.copies, r.links, r.best) for r in df.collect()), key=repr)


def brute_edges(rows, threshold=0.6):
    items, pairs = brute_pairs(rows, threshold=threshold)
    return sorted((*ordered([items[a][1][0], items[b][1][0]]), j) for (a, b), j in pairs.items())


def edges(df):
    return sorted((r.left_id, r.right_id, r.jaccard) for r in df.collect())


def clusters(seed, sizes, length=(5, 200), changed=10):
    """Texts in clusters of near copies, with accidental n-grams in common and a passage that a third of them share."""
    r = random.Random(seed)
    passage, texts = [f"p{k}" for k in range(30)], []
    for g, size in enumerate(sizes):
        base = [f"{'abcdefghij'[r.randrange(10)]}{r.randrange(9)}" for _ in range(r.randint(*length))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // changed))):
                own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(own + passage if g % 3 == 0 else own))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_jaccard_on_nasty_rows(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    assert linked(jaccard.similar(nasty)) == brute_similar(rows)


def test_jaccard_loses_nothing(docs_of):
    rows = clusters(4, [1 + k % 8 for k in range(150)])
    docs = docs_of([(i, t, "s") for i, t in rows])
    want = brute_edges(rows)
    assert len(want) > 300 and edges(jaccard.similar_pairs(docs)) == want
    assert linked(jaccard.similar(docs)) == brute_similar(rows)


@pytest.mark.parametrize("threshold", [0.3, 0.85])
def test_jaccard_at_other_thresholds(docs_of, threshold):
    rows = clusters(6, [4] * 60, (1, 60), 5)
    assert edges(jaccard.similar_pairs(docs_of([(i, t, "s") for i, t in rows]), threshold=threshold)) == brute_edges(rows, threshold)


def test_jaccard_with_every_bound_crossed(docs_of, monkeypatch):
    """Long lists by blocks, groups and partners in parts, small trees, tiles, and tables that are not broadcast."""
    for name, value in (("LIST", 7), ("GROUP_CLASSES", 6), ("PARTNERS", 2), ("TREE_CLASSES", 5), ("TREE_GRAMS", 600), ("CELLS", 1 << 10)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "bounded_broadcast", lambda df, size: df)
    rows = clusters(5, [40, 30, 9, 9, 3, 2, 1, 1, 1] * 2, (20, 120))
    docs = docs_of([(i, t, "s") for i, t in rows])
    assert edges(jaccard.similar_pairs(docs)) == brute_edges(rows)
    assert jaccard.drop_near_copies(docs).count() == len(rows) - len(removed(rows))


def removed(rows):
    items, pairs = brute_pairs(rows)
    root = list(range(len(items)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        x, y = find(a), find(b)
        root[y] = x
    stays = {min(i for k, (_, ids) in enumerate(items) if find(k) == r for i in ids) for r in {find(k) for k in range(len(items))}}
    return {i for _, ids in items for i in ids} - stays


def test_jaccard_of_a_large_cluster(docs_of):
    """2,400 different near copies of one text: several trees of 512 classes, each of three levels above them."""
    r = random.Random(12)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(2400):
        own = list(base)
        for _ in range(r.randint(1, 9)):
            own[r.randrange(120)] = f"u{r.randrange(10**7)}"
        rows.append((i, " ".join(own)))
    sets = gram_sets(rows)
    names = {g: k for k, g in enumerate({g for s, _ in sets for g in s})}
    x = np.zeros((len(sets), 118), np.float32)  # the n-grams of the base text; the others are in one set each
    of_base = {g: k for k, g in enumerate(tuple(base[k : k + 3]) for k in range(118))}
    for k, (s, _) in enumerate(sets):
        x[k, [of_base[g] for g in s if g in of_base]] = 1
    assert len(names) > 10_000 and len(sets) > 2000
    common = x @ x.T
    size = np.array([len(s) for s, _ in sets])
    jaccard_ = common / (size[:, None] + size[None, :] - common)
    np.fill_diagonal(jaccard_, 0)
    want = {ids_[0]: ((jaccard_[k] >= 0.6).sum(), jaccard_[k].max()) for k, (_, ids_) in enumerate(sets)}
    got = {q.doc_id: (q.links, q.best) for q in jaccard.similar(docs_of([(i, t, "s") for i, t in rows])).collect()}
    assert len(got) > 2000 and max(n for n, _ in got.values()) > 1000
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items() if n}
    assert all(abs(b - want[i][1]) < 1e-6 for i, (_, b) in got.items())


def test_jaccard_one_of_each_group_stays(nasty):
    kept = jaccard.drop_near_copies(nasty)
    assert kept.columns == nasty.columns
    assert ordered(r.doc_id for r in kept.select("doc_id").collect()) == ordered([1, 4, 6, None, 7, 8, 9, 10, 12])


def test_jaccard_chain_is_one_group(docs_of):
    w = prose(9, 200).split()
    chain = [" ".join(w[k * 20 : k * 20 + 100]) for k in range(5)]  # each overlaps the next by 80 words
    assert [r.doc_id for r in jaccard.drop_near_copies(docs_of([(10 - i, t, "s") for i, t in enumerate(chain)])).collect()] == [6]


def test_groups_of_a_long_path(spark):
    n = 40
    pairs = spark.createDataFrame([(f"{(i * 7) % n:02d}", f"{((i + 1) * 7) % n:02d}") for i in range(n - 1)], "left string, right string")
    assert {(r.node, r.root) for r in jaccard.groups(pairs).collect()} == {(f"{i:02d}", "00") for i in range(1, n)}


def test_one_tree_of_many_classes_gives_every_pair_and_prunes():
    r = np.random.default_rng(1)
    sets = []
    while len(sets) < 2200:
        base = r.integers(0, 1 << 62, int(r.integers(140, 160)), dtype=np.uint64)
        for _ in range(int(r.integers(1, 30))):
            own = base.copy()
            own[r.integers(0, len(own), int(r.integers(0, 40)))] = r.integers(0, 1 << 62, 1, dtype=np.uint64)
            sets.append(np.unique(own))
    tree = jaccard.Tree(np.array([len(s) for s in sets]), np.stack([jaccard._bits(s, 1024) for s in sets]).view(np.uint64))
    assert len(tree.levels) > 4
    having, want = defaultdict(list), defaultdict(int)
    for k, s in enumerate(sets):
        for g in s.tolist():
            for other in having[g]:
                want[other, k] += 1
            having[g].append(k)
    want = {(i, j) for (i, j), c in want.items() if c >= 0.6 * (len(sets[i]) + len(sets[j]) - c)}
    for other, same in ((tree, True), (tree.folded(8), False)):
        got = set(zip(*(x.tolist() for x in jaccard.traverse(tree, other, 0.6, same))))
        assert want <= got and (not same or all(i < j for i, j in got))
        assert len(got) < 0.2 * len(sets) ** 2


def test_traversal_of_trees_of_different_depth_and_width():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(90)]
    tree = lambda own, bits: jaccard.Tree(np.array([len(s) for s in own]), np.stack([jaccard._bits(s, bits) for s in own]).view(np.uint64))
    for left, right in ((sets[:1], sets[1:]), (sets[:70], sets[70:73]), (sets[:9], sets[9:])):
        got = set(zip(*(x.tolist() for x in jaccard.traverse(tree(left, 512), tree(right, 256), 0.6))))
        assert {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if len(np.intersect1d(x, y)) >= 0.6 * len(np.union1d(x, y))} <= got


def test_overlaps_in_tiles(monkeypatch):
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 400, 120)).astype(np.uint64) for _ in range(30)]
    a, b = np.triu_indices(30, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert jaccard._overlaps(sets, a, b).tolist() == want
    monkeypatch.setattr(jaccard, "CELLS", 1 << 12)
    assert jaccard._overlaps(sets, a, b).tolist() == want
    assert jaccard._overlaps(sets, a[:3], b[:3]).tolist() == want[:3]


def test_jaccard_empty(none):
    assert jaccard.similar(none).count() == jaccard.similar_pairs(none).count() == jaccard.drop_near_copies(none).count() == 0


# ---- suffixes


def brute_spans(rows, threshold):
    seen = defaultdict(list)
    for number, (i, t) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        w = words(t)
        for p in range(len(w) - threshold + 1):
            seen[tuple(w[p : p + threshold])].append((number, i, p))
    kind = {}
    for places in seen.values():
        if len(places) > 1:
            for k, (number, i, p) in enumerate(places):
                kind[number, i, p] = k > 0
    out = []
    for (number, i, p), copy in kind.items():
        if kind.get((number, i, p - 1)) != copy:
            end = p
            while kind.get((number, i, end + 1)) == copy:
                end += 1
            out.append((i, p, end + threshold, copy))
    return sorted(out, key=repr)


def spans(df):
    return sorted(((r.doc_id, r.start_word, r.end_word, r.is_copy) for r in df.collect()), key=repr)


def test_repeats_on_nasty_rows(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    assert spans(repeats.repeated_spans(nasty)) == brute_spans(rows, 50)


@pytest.mark.parametrize(("threshold", "seed"), [(8, 3), (12, 12 // 2), (20, 1), (40, 1), (9, 8)])
def test_repeats_at_other_lengths(docs_of, threshold, seed):
    r = random.Random(threshold)
    passages = [[f"p{r.randrange(4)}" for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(25):
        text = []
        for _ in range(r.randint(0, 4)):
            s = r.randrange(40)
            text += r.choice(passages)[s : s + r.randint(3, 25)] + [f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 6))]
        rows.append((i, " ".join(text)))
    got = repeats.repeated_spans(docs_of([(i, t, "s") for i, t in rows]), threshold=threshold, seed=seed, bucket_rows=40)
    assert spans(got) == brute_spans(rows, threshold)


def test_repeats_without_broadcast(spark, nasty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    monkeypatch.setattr(repeats, "bounded_broadcast", lambda df, size: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert spans(repeats.repeated_spans(nasty)) == brute_spans(rows, 50)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_double_to_the_threshold():
    assert repeats._lengths(50, repeats.SEED) == [7, 14, 28, 50] and repeats._lengths(40, 1) == [1, 2, 4, 8, 16, 32, 40]


def test_a_window_in_many_documents_takes_few_rows(spark):
    """One passage in 50,000 documents, with words of their own around it; far more than a bucket's rows."""
    passage = " ".join(f"p{k}" for k in range(12))
    docs = spark.range(50_000).selectExpr("id AS doc_id", f"concat('a', id, ' {passage} b', id) AS text").repartition(4)
    got = repeats.repeated_spans(docs, threshold=10, seed=1, bucket_rows=500).agg(F.count(F.lit(1)), F.min("start_word"), F.max("end_word"), F.sum(F.col("is_copy").cast("int")), F.min_by("doc_id", "is_copy")).first()
    assert tuple(got) == (50_000, 1, 13, 49_999, 0)


def test_texts_of_one_key_stay_apart(docs_of, monkeypatch):
    a, b, c, d = prose(1, 120), prose(2, 90), prose(3, 70), prose(4, 60)
    monkeypatch.setattr(repeats, "_text_key", lambda text: F.when(text.startswith(a[:30]) | text.startswith(b[:30]), 1).otherwise(2).cast("bigint"))
    rows = [(1, a), (2, c + " " + a), (3, b), (4, d + " " + b), (5, a), (6, c + " " + a)]
    assert spans(repeats.repeated_spans(docs_of([(i, t, "s") for i, t in rows]))) == brute_spans(rows, 50)


def test_repeats_empty(none):
    assert repeats.repeated_spans(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c", "é", "d9", " ", ".", "\n"]), max_size=60), st.integers(1, 4))
def test_word_hashes(parts, n):
    import pyarrow as pa

    from tidemark.llm import tokens

    texts = ["".join(parts), "", "".join(parts[::-1]), "ab c"]
    data, offs = tokens.raw(pa.array(texts))
    _, _, hashes, at = tokens.words(data, offs)
    own = [words(t) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in own]
    flat = [w for ws in own for w in ws]
    assert len({(w, int(h)) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(hashes.tolist()))
    grams = tokens.grams(hashes, at, n)
    seen = {}
    for k, ws in enumerate(own):
        for p in range(len(ws)):
            g = int(grams[at[k] + p])
            if p + n > len(ws):
                assert g == int(tokens.NEVER)
            else:
                assert seen.setdefault(g, tuple(ws[p : p + n])) == tuple(ws[p : p + n])


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op3_suffix_array_dedup", "op4_exact_dedup"])
def test_against_sql(compare, name):
    compare(queries.QUERIES[name], queries.ORACLES[name])
