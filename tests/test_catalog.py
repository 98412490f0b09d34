"""All event queries against SQL, and the driver's contract."""

import subprocess
import sys
from datetime import datetime, timedelta

import pytest

import __spark_entry__
from tidemark import catalog

from .conftest import SF, same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(compare, name):
    compare(catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "pubkey", "created_at", "kind", "tags", "content"] and df.count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_needs_the_corpus_subpackage():
    code = (
        "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and 'tag_multi_key' in e.queries() and 'pipeline' not in e.queries()"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=__spark_entry__.__file__.rsplit("/", 1)[0], capture_output=True).returncode == 0


def test_top_k_and_pushdown_in_plans(spark, tmp_path):
    from tidemark.plans.filters import Filter
    from tidemark.plans.query import query

    catalog.event_view(spark, SF).write.parquet(str(tmp_path / "ev"))
    ev = spark.read.parquet(str(tmp_path / "ev"))
    plan = query(ev, Filter(kinds=(1,), since=5, tags={"t": ("click",)}, limit=10))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(created_at,5)" in plan and "EqualTo(kind,1)" in plan
    from tidemark.operators.counts import count

    plan = count(ev, Filter(kinds=(1,)))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<kind:int>" in plan


def against_sql(spark, path, name, rows):
    """The query and its SQL over an events table of these rows."""
    import duckdb

    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"SET timezone = 'UTC'; CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    same(catalog.QUERIES[name](spark, str(path)), c.execute(catalog.ORACLES[name]))


T0 = datetime(2024, 1, 1)
#: Events without a time, an author, an id, properties or a type, one before 1970, and one id at two times.
ODD = [
    (1, None, 1, "click", 0.0, '{"k": 1}'), (2, T0, None, "signup", 0.0, '{"k": 2}'), (None, T0, 3, "view", 0.0, '{"k": 3}'), (4, T0, 4, "click", 0.0, None), (5, T0, 5, None, 0.0, '{"j": 1}'),
    (6, datetime(1969, 12, 31, 23, 59, 58), 6, "view", 0.0, '{"k": 4}'), (6, datetime(1969, 12, 31, 23, 59, 59), 6, "view", 0.0, '{"k": 4}'), (7, T0, 7, "click", 0.0, '{"k": 5}'), (7, T0 + timedelta(seconds=1), 7, "click", 0.0, '{"k": 5}'),
]


def test_authors_by_reference_are_counted_exactly(spark, tmp_path):
    rows = [(k, T0 + timedelta(seconds=k), k % 3000, ("signup", "click")[k % 2], 0.0, f'{{"k": {k % 7}}}') for k in range(100, 9000)]
    against_sql(spark, tmp_path / "many", "hll_cache_by_ref", rows)
    against_sql(spark, tmp_path / "odd", "hll_cache_by_ref", ODD)


@pytest.mark.parametrize("name", ["tag_index", "tag_index_lookup"])
def test_tags_of_odd_events(spark, tmp_path, name):
    against_sql(spark, tmp_path, name, ODD)


def test_the_tag_table_moves_each_event_once(spark):
    from tidemark.functions.tags import tag_table
    from tidemark.model import EVENT_SCHEMA

    from .test_conformance import event

    rows = [event(k, k % 9, k, 1, [("t", str(k % 5)), ("e", str(k)), ("t", str(k % 5)), ("long", "x"), ("z",), ("p", "v" * 101), ()]) for k in range(500)] + [event(900, 1, 1, 1, [("long", "x")])]
    again = [(*e[:4], [["d", "y"]], *e[5:]) for e in rows[:50]]  # the same events with another tag
    df = tag_table(spark.createDataFrame(rows + rows[:100] + again, EVENT_SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and plan.index("explode(tags") < plan.index("Exchange hash")
    assert sorted((r.id, r.k, r.v) for r in df.collect()) == sorted({(e[0], t[0], t[1]) for e in rows + again for t in e[4] if len(t) > 1 and t[0] in "ted" and len(t[1]) <= 100})
