"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns (role and text equal) of both conversations, rendered once; what follows
in each is its completion. A completion's mask lists the spans [start, end) of its characters that are trained on: the
text of the assistant's turns with the mark that ends it; headers and the other roles' turns are masked out.

All of it is built-in expressions after one aggregation by conversation. Defined results:

* turns are taken in the order of their number, ties and null numbers (which come first) by role, then text;
* a null role is rendered as an empty one, a null text as an empty text; nulls equal each other in the prefix;
* repeated rows are repeated turns; a conversation may have any number of turns of any length;
* if both sides are equal, the prompt is all of it and both completions are empty; if one side is a prefix of the other,
  its completion is empty; with no turn in common the prompt is empty;
* a conversation with only one side, or a null id, forms no pair; an empty table gives an empty table; other columns are
  not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|im_start|>", "<|im_end|>", "\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """id and turns: the turns of each conversation in order, as structs of role and text."""
    # Key columns lead the struct, so that sorting the array orders the turns.
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ordered = turns.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return ordered.select("id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + END))), "")


def _mask(turns: Column) -> Column:
    """Spans of trained characters, from running lengths of the rendered turns."""
    fixed = len(OPEN) + 1 + len(CLOSE + END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = acc["at"] + F.length(t["role"]) + len(OPEN) + 1
        span = F.struct(head.alias("start"), (head + F.length(t["text"]) + len(CLOSE)).alias("end"))
        return F.struct(
            (acc["at"] + F.length(t["role"]) + F.length(t["text"]) + fixed).alias("at"),
            F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """From id and the arrays chosen and rejected: id, prompt_turns, prompt, completions and their masks."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    # The first place at which the sides differ; none among the shared length means that one is a prefix of the other.
    same = F.zip_with(F.slice("chosen", 1, shorter), F.slice("rejected", 1, shorter), lambda a, b: a == b)
    first = F.array_position(same, False).cast("int")
    cut = pairs.withColumn("n", F.when(first > 0, first - 1).otherwise(shorter))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    split = cut.select("id", "n", F.slice("chosen", 1, F.col("n")).alias("shared"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return split.select(
        "id", F.col("n").alias("prompt_turns"), _render(F.col("shared")).alias("prompt"), _render(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
        _render(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, **columns: str) -> DataFrame:
    """From two tables of turns whose conversations share ids."""
    left, right = conversations(chosen, **columns), conversations(rejected, **columns)
    return format_pairs(left.withColumnRenamed("turns", "chosen").join(right.withColumnRenamed("turns", "rejected"), "id"))


def with_stale_answer(turns: DataFrame, **columns: str) -> DataFrame:
    """Pairs made of single conversations: the rejected side gives its previous answer (or none) again in place of the last."""
    convs = conversations(turns, **columns)
    answers = F.filter("turns", lambda t: t["role"] == TRAINED_ROLE)
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i)), lambda i: i.isNotNull())
    stale = convs.select("id", "turns", F.coalesce(F.get(F.transform(answers, lambda t: t["text"]), F.size(answers) - 2), F.lit("")).alias("stale"), F.coalesce(F.array_max(places), F.lit(-1)).alias("last"))
    rejected = F.transform("turns", lambda t, i: F.when(i == F.col("last"), F.struct(t["role"].alias("role"), F.col("stale").alias("text"))).otherwise(t))
    return stale.select("id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def _sql_mask(turns: str) -> str:
    end = f"list_sum(list_transform({turns}[:i], lambda t: {len(OPEN) + 1 + len(CLOSE + END)} + length(t.role) + length(t.text)))"
    return (
        f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = '{TRAINED_ROLE}'), "
        f"lambda i: cast({end} - 1 - length({turns}[i].text) - {len(CLOSE)} AS bigint) || '-' || cast({end} - 1 AS bigint)), ',')"
    )


def _sql_text(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: '{OPEN}' || t.role || chr(10) || t.text || '{CLOSE}' || chr(10)), '')"


ORACLE = f"""
WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 p AS (SELECT *, list_filter(range(1, len(ts) + 1), lambda i: ts[i].role = '{TRAINED_ROLE}') AS own FROM c),
 q AS (SELECT conv_id, ts AS a, list_transform(range(1, len(ts) + 1), lambda i: {{'role': ts[i].role, 'text': CASE WHEN i = own[-1] THEN coalesce(ts[own[-2]].text, '') ELSE ts[i].text END}}) AS b FROM p),
 n AS (SELECT *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i].role <> b[i].role OR a[i].text <> b[i].text)) - 1, len(a)) AS n FROM q),
 s AS (SELECT conv_id, cast(n AS integer) AS n, a[:n] AS shared, a[n + 1 :] AS x, b[n + 1 :] AS y FROM n)
SELECT conv_id, n AS prompt_turns, {_sql_text("shared")} AS prompt, {_sql_text("x")} AS chosen, {_sql_mask("x")} AS chosen_mask, {_sql_text("y")} AS rejected, {_sql_mask("y")} AS rejected_mask FROM s
"""
