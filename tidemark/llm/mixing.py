"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets an inclusion probability so that its expected tokens follow its target weight within a token budget; a
source with too few tokens is taken whole and the others share the rest (water filling). The flight then moves the
probabilities of a few documents at a time along the null space of the balancing constraints (document total and token
total of the source), so that one of them becomes 0 or 1 and both totals stay as they are. It runs where the rows are:
every task keeps the at most two undecided documents of each source; those few are settled by a second flight per source,
a third over all sources, and a landing that gives up the token constraint, then draws the last document.

Random draws come from a hash of seed, id and length, never from a task's state, so a task that runs again decides alike.
Defined results:

* a null source is a source of its own; a document without words (null, empty, blank text) has no tokens to balance and
  gets its source's probability with token weight 0;
* repeated rows are sampled each for itself; texts may be of any length; an empty table gives an empty table;
* other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, bounded_broadcast, packed, stored

#: Share of all tokens to sample, and the power of a source's tokens that is its weight where no weights are given.
BUDGET_SHARE = 0.7
WEIGHT_POWER = 0.5
SEED = 17
EPS = 1e-9


class Flight:
    """The cube method's flight over units that come one by one; at most two constraints, so at most two stay undecided."""

    __slots__ = ("units",)

    def __init__(self) -> None:
        self.units: list[list] = []  # [name, probability, count weight, token weight]

    def add(self, name, p: float, tokens: float, u: float) -> list[tuple]:
        """Takes one more unit; u in [0, 1) is its random number. Returns the units decided, with True where selected."""
        done: list[tuple] = []
        if p <= EPS or p >= 1 - EPS:
            return [(name, p > 0.5)]
        self.units.append([name, p, 1.0, tokens])
        if len(self.units) < 3:
            return done
        a, b, c = self.units
        # The cross product of the constraints (1, 1, 1) and (tokens) is their null space.
        d = [b[2] * c[3] - b[3] * c[2], c[2] * a[3] - c[3] * a[2], a[2] * b[3] - a[3] * b[2]]
        if max(map(abs, d)) < EPS:  # equal lengths: any move that keeps the sum will do
            d = [1.0, -1.0, 0.0]
        self._move(d, u, done)
        return done

    def _move(self, d: list[float], u: float, done: list[tuple]) -> None:
        up = down = float("inf")
        for unit, x in zip(self.units, d):
            if x > 0:
                up, down = min(up, (1 - unit[1]) / x), min(down, unit[1] / x)
            elif x < 0:
                up, down = min(up, -unit[1] / x), min(down, (unit[1] - 1) / x)
        step = up if u * (up + down) < down else -down
        left = []
        for unit, x in zip(self.units, d):
            unit[1] += step * x
            if unit[1] <= EPS or unit[1] >= 1 - EPS:
                done.append((unit[0], unit[1] > 0.5))
            else:
                left.append(unit)
        self.units = left

    def land(self, draw) -> list[tuple]:
        """Decides the rest: the token constraint goes first, then the document constraint; draw(name) is a random number."""
        done: list[tuple] = []
        while len(self.units) > 1:
            self._move([1.0, -1.0] + [0.0] * (len(self.units) - 2), draw(self.units[0][0]), done)
        for unit in self.units:
            done.append((unit[0], draw(unit[0]) < unit[1]))
        self.units = []
        return done


def _draws(seed: int, ids: list, tokens: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{i}/{t}", seed) for i, t in zip(ids, tokens.tolist())], np.uint64) / 2.0**64


def inclusion(docs: DataFrame, weights: dict[str, float] | None, budget_share: float, source: str = "source", text: str = "text") -> DataFrame:
    """A row for each source: its tokens, its weight, and the probability that fits the budget (by water filling)."""
    totals = (
        packed(docs).select(F.col(f"row.`{source}`").cast("string").alias("source"), F.expr(WORDS.format(f"row.`{text}`")).alias("n"))
        .groupBy("source").agg(F.sum("n").cast("double").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    )
    if weights is None:
        weight = F.pow("tokens", F.lit(WEIGHT_POWER))
    else:
        weight = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.coalesce("source", F.lit(""))), F.lit(0.0))
    # One row for each source, in the order in which sources run out as the level of water rises.
    rows = totals.withColumn("weight", weight).withColumn("bound", F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")).otherwise(F.lit(float("inf"))))
    order = Window.orderBy("bound", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = rows.select(
        "*",
        (F.lit(budget_share) * F.sum("tokens").over(whole) - F.coalesce(F.sum("tokens").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("shared"),
    )
    share = F.try_divide("left", "shared")
    fits = F.when((F.col("shared") > 0) & (share < F.col("bound")), F.greatest(share, F.lit(0.0)))
    level = F.max(fits).over(whole)  # past the first that fits, the levels fall
    p = F.when(F.col("weight") <= 0, 0.0).when(level.isNull(), 1.0).when(F.col("tokens") <= 0, 1.0).otherwise(F.least(F.lit(1.0), level * F.col("weight") / F.col("tokens")))
    return levels.select("source", "tokens", "documents", "weight", p.alias("p"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget_share: float = BUDGET_SHARE, seed: int = SEED, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The sampled documents."""
    plan = stored(inclusion(docs, weights, budget_share, source, text), "mix")
    rows = packed(docs).select(
        "row", F.col(f"row.`{source}`").cast("string").alias("source"), F.col(f"row.`{id_col}`").cast("string").alias("id"), F.expr(WORDS.format(f"row.`{text}`")).cast("double").alias("tokens")
    )
    plan = bounded_broadcast(plan.select(F.col("source").alias("of"), "p"), 64)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of")), "left").select("row", "source", "id", "tokens", F.coalesce("p", F.lit(0.0)).alias("p"))
    first = stored(rows.mapInArrow(_fly(seed), rows.schema), "flown")
    chosen = first.where("p = 1").select("row")
    left = first.where("p < 1")
    second = left.groupBy("source").applyInArrow(_fly_table(seed + 1, False), left.schema)
    settled = stored(second, "settled")
    third = settled.where("p < 1").groupBy(F.lit("all").alias("all")).applyInArrow(_fly_table(seed + 2, True), left.schema)
    return chosen.unionByName(settled.where("p = 1").select("row")).unionByName(third.select("row")).select("row.*")


def _fly(seed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flights: dict[str | None, Flight] = {}
        held: dict[str | None, dict[tuple, pa.Table]] = {}  # the rows of undecided documents, by name within their flight
        for number, batch in enumerate(batches):
            yield from _advance(number, pa.Table.from_batches([batch]), flights, held, seed)
        for key, flight in flights.items():
            for name, p, *_ in flight.units:
                yield from _with_p(held[key][name], [p]).to_batches()

    return task


def _advance(number: int, table: pa.Table, flights: dict, held: dict, seed: int) -> Iterator[pa.RecordBatch]:
    sources, ids, ps = (table.column(c).to_pylist() for c in ("source", "id", "p"))
    tokens = table.column("tokens").to_numpy()
    draws = _draws(seed, ids, tokens)
    picked: list[int] = []
    older: list[pa.Table] = []
    for i, key in enumerate(sources):
        flight = flights.get(key)
        if flight is None:
            flight = flights[key] = Flight()
            held[key] = {}
        for name, chosen in flight.add((number, i), ps[i], float(tokens[i]), draws[i]):
            if name in held[key]:
                row = held[key].pop(name)
                if chosen:
                    older.append(row)
            elif chosen:
                picked.append(name[1])
    for key, flight in flights.items():
        for name, *_ in flight.units:
            if name not in held[key]:
                held[key][name] = table.take([name[1]])
    if picked:
        yield from _with_p(table.take(picked), [1.0] * len(picked)).to_batches()
    for row in older:
        yield from _with_p(row, [1.0]).to_batches()


def _with_p(table: pa.Table, ps: list[float]) -> pa.Table:
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(ps, pa.float64()))


def _fly_table(seed: int, land: bool):
    """Flies over one group; with land, every document is decided."""

    def group(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=lambda i: (str(table.column("id")[i]), table.column("tokens")[i].as_py()))
        table = table.take(order)
        ids, ps, tokens = table.column("id").to_pylist(), table.column("p").to_pylist(), table.column("tokens").to_numpy()
        draws, flight, out = _draws(seed, ids, tokens), Flight(), []
        for i, p in enumerate(ps):
            out += [(name, 1.0) for name, chosen in flight.add(i, p, float(tokens[i]), draws[i]) if chosen]
        if land:
            more = _draws(seed + 1, ids, tokens)
            out += [(name, 1.0) for name, chosen in flight.land(lambda i: more[i]) if chosen]
        out += [(unit[0], unit[1]) for unit in flight.units]
        return _with_p(table.take(pa.array([i for i, _ in out], pa.int64())), [p for _, p in out])

    return group
