"""The pipeline stage by stage against plain versions over whole small tables."""

from collections import defaultdict

import corpus_pipeline
from tests.conftest import SF
from tidemark.llm import lines, mixing

from .test_dedup import words
from .test_selection import covered, fill, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.persist()
        out[name] = docs.collect()
        assert docs.columns == COLUMNS or name == "best-fit packing"

    want = [tuple(r) for r in duck.execute(f"SELECT doc_id, text, lang, source, n_chars FROM ({lines.oracle()})").fetchall()]
    assert sorted(map(tuple, out["quality rules"])) == sorted(want)

    first = {}
    for row in sorted(want):
        first.setdefault(row[1], row)
    assert sorted(map(tuple, out["exact dedup"])) == sorted(first.values())

    sets = {r[0]: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w := words(r[1])) > 2 else {tuple(w)} for r in first.values()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = {r.doc_id: r for r in out["n-gram jaccard join"]}
    assert set(kept) == {i for i in sets if find(i) == i}
    assert all(tuple(r) in set(first.values()) for r in kept.values())

    totals = defaultdict(int)
    for r in kept.values():
        totals[r.source] += tokens(r.text)
    p = fill(totals, {s: t**mixing.WEIGHT_POWER for s, t in totals.items()}, mixing.BUDGET_SHARE * sum(totals.values()))
    mixed = {r.doc_id: r for r in out["source mixing"]}
    assert all(kept[i] == r for i, r in mixed.items()) and len(mixed) == len(out["source mixing"])
    for s in totals:
        assert abs(sum(r.source == s for r in mixed.values()) - sum(p[s] for r in kept.values() if r.source == s)) <= 2.5

    own = covered(out["best-fit packing"], 2048)
    assert {i: sum(n for _, n in x) for i, x in own.items()} == {i: tokens(r.text) for i, r in mixed.items()}


def test_run(spark):
    bins = corpus_pipeline.run(spark, SF)
    assert bins.columns == ["bin_id", "doc_ids", "starts", "lengths", "tokens"]
    assert bins.count() > 0


def test_nasty_and_empty_documents_pass_through(spark, nasty, none):
    for docs in (nasty, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
