"""Generated event sets, queried through every store, against a brute-force oracle with the order of rows."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.model import EVENT_SCHEMA
from tidemark.plans.filters import BadHex, EmptyTagSet, Filter, FilterError, TooManyValues, parse_envelope
from tidemark.plans.query import PROFILES, Limits, query, query_any, query_profile
from tidemark.sources.store import FrameStore, MemoryStore, ParquetStore

H = lambda x: hashlib.sha256(str(x).encode()).hexdigest()


def event(n, author, at, kind, tags=(), content="hello"):
    return (H(f"{n}/{author}/{at}/{kind}"), H(author), at, kind, [list(t) for t in tags], content, "")


def first():
    return [event(i, "sk4" if i % 3 == 0 else "sk3", i * 10 + 2, 9 if i % 2 == 0 else 1, [("t", str(i)), ("e", "0" + str(i) + "0" * 62)], f"hello {i}") for i in range(10)]


def second():
    return [event(i, "sk4" if i % 3 == 0 else "sk3", i * 10 + 2, i % 10, [("t", f"t{i}"), ("e", f"{i:04x}" + "0" * 60), ("p", H("p3" if i % 2 else "p4"))], f"hi {i}") for i in range(10_000)]


def many_authors():
    return [event(i, i % 2000 + 1, i * i // 4, i % 10) for i in range(10_000)]


def unbalanced():
    return [event(i, i % 2800 + 1, (i % 2800 + 1) * 1000 + i, 1) for i in range(10_000)]


def matches(f, e):
    i, pubkey, at, kind, tags, *_ = e
    return (
        (not f.ids or i in f.ids) and (not f.authors or pubkey in f.authors) and (not f.kinds or kind in f.kinds) and (f.since is None or at >= f.since) and (f.until is None or at <= f.until)
        and all(any(len(t) > 1 and t[0] == k and t[1] in v for t in tags) for k, v in f.tags.items())
    )


def brute(rows, f, most=500):
    n = most if f.limit is None else min(f.limit, most)
    return [e[0] for e in sorted((e for e in rows if matches(f, e)), key=lambda e: (-e[2], e[0]))[:n]]


@pytest.fixture(scope="module")
def sets(spark, tmp_path_factory):
    out = {}
    for make in (first, second, many_authors, unbalanced):
        rows = make()
        path = str(tmp_path_factory.mktemp(make.__name__) / "store")
        store = ParquetStore(spark, path).open()
        store.save(spark.createDataFrame(rows, EVENT_SCHEMA))
        store.rebuild_tags()
        frame = spark.createDataFrame(rows, EVENT_SCHEMA).cache()
        out[make.__name__] = rows, [FrameStore(frame), store]
    return out


SECOND = [
    Filter(kinds=(1, 4, 8, 2)), Filter(kinds=(1, 4, 8, 2), tags={"p": (H("p3"), H("p4"))}), Filter(kinds=(1, 4, 8, 2), since=1, until=99_999), Filter(authors=(H("sk3"), H("sk4"))),
    Filter(authors=(H("sk3"),), kinds=(6, 7, 8)), Filter(tags={"p": (H("p3"),)}, limit=100), Filter(tags={"t": ("t1", "t10", "t100")}), Filter(tags={"t": ("t1",), "e": ("0001" + "0" * 60,)}), Filter(limit=20),
    Filter(since=50_000, until=60_000, kinds=(3,)), Filter(tags={"e": (f"{7:04x}" + "0" * 60,)}), Filter(authors=(H("sk4"),), tags={"p": (H("p4"),)}, until=30_000),
]


@pytest.mark.parametrize("f", SECOND)
def test_second(sets, f):
    rows, stores = sets["second"]
    want = brute(rows, f)
    assert want
    for store in stores:
        assert [r["id"] for r in store.query_list(f)] == want
        assert store.count(f) == sum(matches(f, e) for e in rows)


FIRST = [
    Filter(), Filter(since=32), Filter(until=32), Filter(since=31, until=33), Filter(kinds=(9,)), Filter(authors=(H("sk4"),), kinds=(9,)), Filter(tags={"t": ("2", "3")}), Filter(ids=tuple(e[0] for e in first()[3:5])),
    Filter(limit=0), Filter(ids=("ff" * 32,)),
]


@pytest.mark.parametrize("f", FIRST)
def test_first(sets, f):
    rows, stores = sets["first"]
    for store in stores:
        assert [r["id"] for r in store.query_list(f)] == brute(rows, f)


def test_many_authors(sets):
    rows, stores = sets["many_authors"]
    f = Filter(authors=tuple(H(i) for i in range(1, 1701)), kinds=(6, 7, 8), limit=500)
    for store in stores:
        store.guards = None
        assert [r["id"] for r in store.query_list(f)] == brute(rows, f)


def test_unbalanced(sets):
    rows, stores = sets["unbalanced"]
    f = Filter(authors=tuple(H(i * 2) for i in range(1, 1401)), limit=160)
    for store in stores:
        store.guards = None
        assert [r["id"] for r in store.query_list(f)] == brute(rows, f)


SEEDS = [(256, 31, 260, 2, 69, 385, 1), (267, 50, 355, 2, 69, 213, 1), (280, 0, 13, 2, 2, 0, 0), (259, 126, 5, 23, 0, 0, 92), (201, 50, 13, 97, 0, 0, 77), (164, 50, 13, 1, 2, 13, 0), (200, 50, 13, 8, 2, 0, 1), (200, 117, 13, 2, 2, 0, 1), (200, 50, 13, 2, 2, 0, 0), (200, 50, 13, 2, 2, 0, 1)]


@pytest.mark.parametrize("seed", SEEDS)
def test_seeds(spark, seed):
    total, limit, authors, factor, spread, kinds, step = seed
    most = kinds * step or 1
    rows = [event(i, i % (authors * spread) + 1 if spread else 1, ((i % (authors * spread)) + 1 if spread else 1) * factor + i, i % most) for i in range(total + 1)]
    f = Filter(authors=tuple(H(i * max(1, spread)) for i in range(1, authors + 1)), kinds=tuple(i * step for i in range(kinds) if i * step < 65536), limit=limit)
    got = query(spark.createDataFrame(rows, EVENT_SCHEMA), f, guards=None).collect()
    assert [r.id for r in got] == brute(rows, f)


@settings(max_examples=15, deadline=None)
@given(st.data())
def test_random_filters(sets, data):
    rows, (frame, _) = sets["second"]
    pick = lambda xs, n: tuple(data.draw(st.lists(st.sampled_from(xs), max_size=n, unique=True)))
    f = Filter(pick([e[0] for e in rows[:20]], 3), pick([H("sk3"), H("sk4"), H("no")], 2), pick(list(range(12)), 3), data.draw(st.sampled_from([{}, {"t": ("t5", "t7")}, {"p": (H("p3"),)}])), data.draw(st.none() | st.integers(0, 99_999)), data.draw(st.none() | st.integers(0, 99_999)), "", data.draw(st.none() | st.integers(0, 600)))
    assert [r["id"] for r in frame.query_list(f)] == brute(rows, f)


# ---- the filter language


def test_parse_and_print():
    f = Filter.parse('{"ids":["a"],"authors":["b"],"kinds":[1,2],"#t":["x","y"],"since":1,"until":9,"search":"w","limit":3}')
    assert f == Filter(("a",), ("b",), (1, 2), {"t": ("x", "y")}, 1, 9, "w", 3) == Filter.parse(f.to_json())
    for bad in ("[]", '{"kinds":["x"]}', '{"#t":5}'):
        with pytest.raises(ValueError):
            Filter.parse(bad)


def test_guards():
    for f in (Filter(ids=("a",) * 501), Filter(authors=("a",) * 501), Filter(kinds=tuple(range(11))), Filter(tags={"t": ("x",) * 101})):
        with pytest.raises(TooManyValues):
            f.check()
        assert f.check(None) is f
    with pytest.raises(EmptyTagSet):
        Filter(tags={"t": ()}).check()
    with pytest.raises(BadHex):
        Filter(authors=("xyz",)).check(strict_hex=True)


def test_envelopes():
    e = {"id": "a", "pubkey": "b", "created_at": 1, "kind": 1}
    import json

    assert parse_envelope(json.dumps(["EVENT", e])) == parse_envelope(json.dumps(e)) == ("event", e)
    assert parse_envelope('["REQ","s",{"kinds":[1]},{"kinds":[2]}]') == ("filters", [Filter(kinds=(1,)), Filter(kinds=(2,))])
    assert parse_envelope('{"limit":1}') == ("filters", [Filter(limit=1)])
    for bad in ("{}", "5", '["CLOSE","s"]'):
        with pytest.raises(FilterError):
            parse_envelope(bad)


@pytest.mark.parametrize(("limits", "asked", "got"), [(Limits(), None, 500), (Limits(), 501, 500), (Limits(), 0, 0), (Limits(1000, 250, 250), None, 250), (Limits(1000, 250, 250), 1001, 250), (Limits(1000, 250, 250), 900, 900), (Limits(150, 40), None, 40), (Limits(150, 40), 200, 150), (Limits(), -3, 0)])
def test_limits(limits, asked, got):
    assert limits.rows(asked) == got
    assert limits.rows(asked, sync_session=True) == (1 << 24 if asked is None else max(0, asked))


@pytest.mark.parametrize("profile", sorted(PROFILES))
def test_profiles_run(sets, profile):
    rows, (frame, _) = sets["first"]
    got = query_profile(frame.events(), Filter(tags={"t": ("2",)}), profile).collect()
    assert rows[2][0] in {r.id for r in got}
    assert query_profile(frame.events(), Filter(search="hello"), profile).count() == (0 if PROFILES[profile][1].search == "disabled" else 10)


def test_long_lists_are_joined(sets):
    rows, (frame, _) = sets["second"]
    ids = tuple(e[0] for e in rows[:1500])
    assert len(query(frame.events(), Filter(ids=ids, kinds=(3,)), guards=None).collect()) == 150


def test_any_of_several(sets):
    rows, (frame, _) = sets["first"]
    f, g = Filter(kinds=(9,)), Filter(since=50)
    want = [e[0] for e in sorted((e for e in rows if matches(f, e) or matches(g, e)), key=lambda e: (-e[2], e[0]))]
    assert [r.id for r in query_any(frame.events(), [f, g]).collect()] == want
    assert [r.id for r in query_any(frame.events(), [Filter(kinds=(9,), limit=99), g]).collect()] == want
    assert query_any(frame.events(), []).count() == 0


def test_memory_store(spark):
    store = MemoryStore(spark)
    assert store.save(spark.createDataFrame(first(), EVENT_SCHEMA)) == 10 and store.save(spark.createDataFrame(first(), EVENT_SCHEMA)) == 0
    assert [r["id"] for r in store.query_list(Filter(limit=3))] == brute(first(), Filter(limit=3))
    random.seed(1)
    store.delete([first()[0][0], "unknown"])
    assert store.count(Filter()) == 9
