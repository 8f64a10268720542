"""Row patterns, sequences, funnels and retention.

Conditions are Spark expressions, evaluated before any ordering in Python; a matcher sees a row as its time and the
variables that hold. Funnels, sequences and retention need no matcher: they are folds over sorted arrays, a
regular expression over event codes, and plain sums.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import patterns as P
from .compose import STRETCH, sessions
from .samples import tick_of, time_of


#: Runs that are matched in one call: enough that a call is no cost of its own, and no more than a task holds.
RUNS = 64


def prev(column: str, keys: Sequence[str], ts: str, n: int = 1) -> Column:
    """The value n rows before, for DEFINE."""
    return F.lag(column, n).over(Window.partitionBy(*keys).orderBy(ts))


def following(column: str, keys: Sequence[str], ts: str, n: int = 1) -> Column:
    return F.lead(column, n).over(Window.partitionBy(*keys).orderBy(ts))


def match_pattern(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    pattern: str,
    define: Mapping[str, Column],
    within,
    measures: Mapping[str, tuple[str, str | None, str | None]] | None = None,
    subset: Mapping[str, Sequence[str]] | None = None,
    rows: str = "ONE",
    skip: str = "PAST LAST ROW",
    order: Sequence[str] = (),
    stretch=STRETCH,
) -> DataFrame:
    """Matches of ``pattern`` in each partition's rows by time; rows without a time are in none of the modes.

    No match reaches over a pause longer than ``within``, so a partition is cut at its pauses and the runs between them are
    matched by themselves, wherever they are; numbers then go on from run to run. Pauses are found by stretches of
    ``stretch`` ticks, as sessions are.

    ``define``: a condition per variable (one without a condition always holds), with prev() and following() for other
    rows. ``within`` bounds a match in ticks and is required. ``measures``: name -> (what, variable or None, column), what
    being FIRST, LAST, COUNT, SUM, MIN, MAX or AVG. ``rows``: ONE row per match with match_number, its first and last
    time and the measures; ALL rows with match_number and classifier, without excluded ones; ALL WITH UNMATCHED.
    """
    if within is None:
        raise ValueError("WITHIN must be given")
    from ..plans.grid import checked_width

    within = checked_width(within, "WITHIN")
    if rows not in ("ONE", "ALL", "ALL WITH UNMATCHED"):
        raise ValueError(f"no rows mode {rows}")
    tree, subset = P.parse(pattern), {k: tuple(v) for k, v in (subset or {}).items()}
    variables = P.names_of(tree)
    kind = df.schema[ts].dataType
    measures = dict(measures or {})
    columns = list(dict.fromkeys(c for _, _, c in measures.values() if c))
    held = F.concat(*[F.when(define[v], "1").otherwise("0") if v in define else F.lit("1") for v in variables])
    shown = [c for c in df.columns if c not in keys] if rows != "ONE" else columns
    slim = df.withColumn("_held", held).select(*keys, *shown, "_held", *([F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]), tick_of(df, ts).alias("_tick"))
    slim = sessions(slim.where("_tick IS NOT NULL"), keys, "_tick", within, stretch, "_run")
    if P.anchored(tree, "$"):
        ends = slim.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("_run").alias("_end"))
        alike = F.lit(True)
        for i, k in enumerate(keys):
            alike = alike & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        slim = slim.join(ends, alike).drop(*[f"_k{i}" for i in range(len(keys))])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def result(what: str, column: str | None) -> str:
        return "bigint" if what == "COUNT" else "double" if what in ("SUM", "AVG") else types[column]

    key_types = ", ".join(f"`{k}` {types[k]}" for k in keys)
    key_types += (", " if keys else "") + "_run bigint, _found bigint"
    if rows == "ONE":
        schema = f"{key_types}, match_number bigint, _t0 bigint, _t1 bigint" + "".join(f", `{n}` {result(w, c)}" for n, (w, _, c) in measures.items())
    else:
        schema = f"{key_types}" + "".join(f", `{c}` {types[c]}" for c in shown) + ", match_number bigint, classifier string"
    index = {v: i for i, v in enumerate(variables)}

    def match(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs that follow each other: the rows of one lie together once they are in order."""
        pdf = pdf.sort_values(["_tick", *[f"_o{i}" for i in range(len(order))]], kind="stable").reset_index(drop=True)
        every = {c: pdf[c].tolist() for c in ("_held", "_tick", "_run")}
        end = pdf["_end"].iloc[0] if "_end" in pdf else None
        starts = [0, *(i for i in range(1, len(pdf)) if every["_run"][i] != every["_run"][i - 1]), len(pdf)]
        out: list[dict] = []
        for low, high in zip(starts, starts[1:]):
            number_of = every["_run"][low]
            flags, times = every["_held"][low:high], every["_tick"][low:high]
            here = P.within_run(tree, number_of == 0, number_of == end)
            found = P.find_all(here, high - low, lambda v, i, taken, flags=flags: flags[i][index[v]] == "1", times, within, skip, subset)
            if rows == "ONE":
                for number, steps in enumerate(found, 1):
                    row = dict(zip(keys, key)) | {"_run": number_of, "_found": len(found) if number == 1 else None, "match_number": number, "_t0": times[steps[0][0]], "_t1": times[steps[-1][0]]}
                    for name, (what, variable, column) in measures.items():
                        members = None if variable is None else subset.get(variable, (variable,))
                        at = [low + i for i, v, _ in steps if members is None or v in members]
                        if what == "COUNT":
                            row[name] = len(at)
                            continue
                        values = [pdf[column].iloc[i] for i in at]
                        pick = {"FIRST": lambda x: x[0], "LAST": lambda x: x[-1], "MIN": min, "MAX": max, "SUM": lambda x: float(sum(x)), "AVG": lambda x: float(sum(x)) / len(x)}[what]
                        row[name] = pick(values) if values else None
                    out.append(row)
                continue
            whole = lambda i, at=low, run=number_of: {c: pdf[c].iloc[at + i] for c in (*keys, *shown)} | {"_run": run, "_found": None}
            # A row that only says how many matches there are, since all rows of a match may be excluded.
            if found:
                out.append({**whole(0), "_found": len(found), "match_number": None, "classifier": None})
            seen: set[int] = set()
            for number, steps in enumerate(found, 1):
                for i, v, left_out in steps:
                    seen.add(i)
                    if not left_out:
                        out.append({**whole(i), "match_number": number, "classifier": v})
            if rows == "ALL WITH UNMATCHED":
                out += [{**whole(i), "match_number": None, "classifier": None} for i in range(high - low) if i not in seen]
        return pd.DataFrame(out, columns=[*keys, "_run", "_found", *(["match_number", "_t0", "_t1", *measures] if rows == "ONE" else [*shown, "match_number", "classifier"])])

    matched = slim.groupBy(*keys, F.floor(F.col("_run") / RUNS)).applyInPandas(lambda key, pdf: match(key[: len(keys)], pdf), schema)
    before = Window.partitionBy(*keys).orderBy("_run").rangeBetween(Window.unboundedPreceding, -1)
    matched = matched.withColumn("match_number", F.col("match_number") + F.coalesce(F.sum("_found").over(before), F.lit(0)))
    if rows != "ONE":
        return matched.where("_found IS NULL").drop("_run", "_found")
    return matched.select(*keys, "match_number", time_of(kind, F.col("_t0")).alias("match_start"), time_of(kind, F.col("_t1")).alias("match_end"), *measures)


def _codes(df: DataFrame, keys: Sequence[str], ts: str, conditions: Sequence[Column], order: Sequence[str] = ()) -> DataFrame:
    """(keys, codes): for each event that meets a condition, by time, a comma and a digit for every condition: whether it holds."""
    mask = F.concat(F.lit(","), *[F.when(c, "1").otherwise("0") for c in conditions])
    events = df.select(*keys, F.struct(tick_of(df, ts).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], mask.alias("m")).alias("e"), mask.alias("m"))
    every = df.select(*keys).distinct()
    codes = events.where(F.contains("m", F.lit("1"))).groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("a"))
    codes = codes.select(*keys, F.array_join(F.transform("a", lambda e: e["m"]), "").alias("codes"))
    return every.join(codes, list(keys), "left").select(*keys, F.coalesce("codes", F.lit("")).alias("codes"))


def _regex(pattern: str, n: int) -> str:
    """(?1) is an event that meets the first condition, .* any events, . one."""

    def one(m: re.Match) -> str:
        if not m[1]:
            return f"(?:,[01]{{{n}}})"
        k = int(m[1])
        if not 1 <= k <= n:
            raise ValueError(f"sequence: no condition {k}")
        return f"(?:,[01]{{{k - 1}}}1[01]{{{n - k}}})"

    rest = re.sub(r"\(\?(\d+)\)", "", pattern)
    if rest.strip(".*+?"):
        raise ValueError(f"sequence: cannot read {rest!r}")
    return re.sub(r"\(\?(\d+)\)|\.", one, pattern)


def sequence_match(df: DataFrame, keys: Sequence[str], ts: str, pattern: str, conditions: Sequence[Column], order: Sequence[str] = ()) -> DataFrame:
    """(keys, matched): whether the events that meet any condition, by time, hold the sequence."""
    return _codes(df, keys, ts, conditions, order).select(*keys, F.col("codes").rlike(_regex(pattern, len(conditions))).alias("matched"))


def sequence_count(df: DataFrame, keys: Sequence[str], ts: str, pattern: str, conditions: Sequence[Column], order: Sequence[str] = ()) -> DataFrame:
    """(keys, n): how many times, without overlap; inner gaps are as short as can be."""
    lazy = re.sub(r"\.([*+])(?!\?)", r".\1?", pattern)
    return _codes(df, keys, ts, conditions, order).select(*keys, F.regexp_count("codes", F.lit(_regex(lazy, len(conditions)))).cast("long").alias("n"))


def window_funnel(df: DataFrame, keys: Sequence[str], ts: str, window, steps: Sequence[Column]) -> DataFrame:
    """(keys, level): the most steps reached in order within ``window`` ticks of the first."""
    from ..plans.grid import checked_width

    window = checked_width(window)
    met = F.filter(F.array(*[F.when(c, i) for i, c in enumerate(steps)]), lambda i: i.isNotNull())
    events = df.select(*keys, tick_of(df, ts).alias("t"), met.alias("met"))
    every = df.select(*keys).distinct()
    # At one time later steps come first, so that an event does not follow itself.
    rows = events.select(*keys, "t", F.explode("met").alias("i"))
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", (-F.col("i")).alias("i")))).alias("a"))
    none = F.array_repeat(F.lit(None).cast("long"), len(steps))

    def step(began: Column, e: Column) -> Column:
        i = -e["i"]
        before = F.when(i == 0, e["t"]).otherwise(F.try_element_at(began, i))
        ok = before.isNotNull() & (e["t"] - before <= window)
        return F.transform(began, lambda old, k: F.when((k == i) & ok, before).otherwise(old))

    reached = F.aggregate("a", none, step, lambda began: F.size(F.filter(began, lambda x: x.isNotNull())))
    levels = packed.select(*keys, reached.alias("level"))
    return every.join(levels, list(keys), "left").select(*keys, F.coalesce("level", F.lit(0)).alias("level"))


def retention(df: DataFrame, keys: Sequence[str], conditions: Sequence[Column]) -> DataFrame:
    """(keys, flags): the first condition, and for each other whether it and the first were ever met."""
    met = df.groupBy(*keys).agg(*[F.coalesce(F.max(c), F.lit(False)).alias(f"_c{i}") for i, c in enumerate(conditions)])
    return met.select(*keys, F.array(*[(F.col("_c0") & F.col(f"_c{i}")).cast("int") for i in range(len(conditions))]).alias("flags"))
