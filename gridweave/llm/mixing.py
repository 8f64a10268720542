"""Mixing sources to target weights: hierarchical budgets, then a prefix of each leaf's seeded epochs.

Leaves are (domain, lang, source). A node's budget goes to its children in proportion to their weights; a child
that cannot use its share (its capacity is its tokens times the epochs allowed) is filled, and what it leaves goes to
its siblings in proportion to theirs, until all are full. A node is given no more than it can hold, so a shortage
is met among siblings before any ancestor's siblings see it. Then each leaf's documents, in an order
seeded by epoch, are taken as whole epochs and a prefix of the next one. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE_CLASS, fresh, materialize, small, table, text_of

LEVELS = ("domain", "lang", "source")


def default_domain() -> Column:
    """The tables name no domain: sources srcN fall into four by N modulo 4, others into 'other'."""
    n = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src(\d{1,9})$", 1)
    return F.when(n == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (n.cast("long") % 4).cast("string")))


@dataclass(frozen=True)
class Mix:
    """Integer weights by name at each level (1 where a name has none), the budget as a part of all tokens, and epochs."""

    weights: Mapping[str, Mapping[str, int]] = field(
        default_factory=lambda: {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
    )
    numerator: int = 4
    denominator: int = 5
    max_epochs: int = 2
    seed: int = 17


PRODUCTION = Mix()


def n_tokens() -> Column:
    """Words between white space."""
    return F.size(F.array_remove(F.split(text_of(), f"[{SPACE_CLASS}]+"), "")).cast("long")


def order_key(seed: int, epoch: Column) -> Column:
    said = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _fill(children: DataFrame, level: str, parent: list[str], mix: Mix) -> DataFrame:
    """``children`` with their share of the parent's budget (column ``given``, a double) as ``budget``."""
    rated = children.withColumn("w", _weight(level, mix.weights.get(level, {}))).withColumn("r", F.col("cap").cast("double") / F.col("w"))
    of = Window.partitionBy(*(parent or [F.lit(0)]))
    order = of.orderBy("r", level)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_from = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rated = rated.withColumn("rise", (F.col("given") - before) / weight_from.cast("double"))
    rated = rated.withColumn("full", F.col("r") <= F.col("rise"))
    rise = F.max(F.when(~F.col("full"), F.col("rise"))).over(of)
    budget = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.greatest(rise, F.lit(0.0)) * F.col("w"))
    return rated.withColumn("budget", budget).drop("w", "r", "rise", "full", "given")


def leaf_budgets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """From (domain, lang, source, n_docs, tokens) per leaf: the same with budget, full_epochs and rest (all long)."""
    leaves = sizes.withColumn("cap", F.col("tokens") * mix.max_epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * mix.numerator / mix.denominator).cast("double").alias("given"))
    given, at = None, []
    for level in LEVELS:
        nodes = leaves.groupBy(*at, level).agg(F.sum("cap").alias("cap"))
        nodes = nodes.crossJoin(F.broadcast(total)) if given is None else nodes.join(given, at)  # a one-row aggregate
        given = _fill(nodes, level, at, mix).drop("cap").withColumnRenamed("budget", "given")
        at = [*at, level]
    out = leaves.drop("cap").join(given, list(LEVELS)).withColumn("budget", F.floor("given").cast("long")).drop("given")
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")
    return out.withColumn("full_epochs", epochs).withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens"))


def named(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """doc_id, the leaf's names (null: 'unknown') and n_tokens."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return docs.select("doc_id", (default_domain() if domain is None else domain).alias("domain"), known("lang"), known("source"), n_tokens().alias("n_tokens"))


def cuts(docs: DataFrame, mix: Mix = PRODUCTION, domain: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The named rows, and for each leaf its budget and the last order key of the epoch that is taken in part.

    The cut is found in two steps so that no leaf is sorted in one task: sums over ranges of the key, some thousand
    documents each, name the range in which the budget ends, and only that range is ordered. Rows with equal ids have
    equal keys and are taken together or not at all.
    """
    rows = materialize(named(docs, domain), "mixing-rows")
    sizes = rows.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    leaves = leaf_budgets(materialize(sizes, "mixing-sizes"), mix)
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("n_docs") / 1024.0)))).cast("int")
    leaves = materialize(leaves.withColumn("shift", F.lit(60) - bits), "mixing-leaves")
    side, _ = small(leaves)
    keyed = rows.join(side, list(LEVELS)).withColumn("key", order_key(mix.seed, F.col("full_epochs"))).withColumn("range", F.expr("shiftright(key, shift)"))
    sums = keyed.groupBy(*LEVELS, "range", "rest", "shift").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("range")
    sums = sums.withColumn("cum", F.sum("n").over(upto)).where(F.col("cum") > F.col("rest"))
    ends = sums.groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("cum") - F.col("n")).alias("before"))).alias("e"))
    ends = materialize(ends.select(*LEVELS, F.col("e.range").alias("range"), F.col("e.before").alias("before")), "mixing-ends")
    side, _ = small(ends)
    last = keyed.join(side, [*LEVELS, "range"])
    inside = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("cum", F.col("before") + F.sum("n_tokens").over(inside)).where(F.col("cum") <= F.col("rest"))
    last = last.groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    out = leaves.join(ends, list(LEVELS), "left").join(last, list(LEVELS), "left")
    # No range passes the budget only where the whole epoch fits; then every key is within the cut.
    below = F.when(F.col("range").isNull(), F.lit((1 << 60) - 1)).otherwise(F.expr("shiftleft(range, shift) - 1"))
    return rows, materialize(out.withColumn("cut", F.coalesce("last_key", below)).drop("range", "before", "last_key", "shift"), "mixing-cuts")


def _copies(mix: Mix, full: str = "full_epochs", cut: str = "cut") -> Column:
    """Epochs in which a document is taken. A partial epoch takes whole documents, up to the cut and not beyond the epochs allowed."""
    partial = (order_key(mix.seed, F.col(full)) <= F.col(cut)) & (F.col(full) < mix.max_epochs)
    return (F.col(full) + F.when(partial, 1).otherwise(0)).cast("long")


def mix_report(docs: DataFrame, mix: Mix = PRODUCTION, domain: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, domain, lang, source, n_tokens, the leaf's budget, and copies taken.

    Null names are 'unknown'; null or empty text has no tokens and costs nothing; an empty table gives no rows.
    """
    rows, ends = cuts(docs, mix, domain)
    side, _ = small(ends)
    return rows.join(side, list(LEVELS)).select("doc_id", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), _copies(mix).alias("copies"))


def mix_documents(docs: DataFrame, mix: Mix = PRODUCTION, domain: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that are taken, with all their columns, each as often as it is taken.

    Null names are 'unknown'; null and empty texts cost nothing; long texts are counted whole; rows with equal ids have equal
    places in the order and are taken together or not at all, and so are null ids. An empty table gives no rows.
    """
    _, ends = cuts(docs, mix, domain)
    side, _ = small(ends)
    names = dict(zip(LEVELS, fresh(docs, *[f"_leaf_{c}" for c in LEVELS])))
    full, cut, copies, epoch = fresh(docs, "_full", "_cut", "_copies", "_epoch")
    side = side.select(*[F.col(c).alias(names[c]) for c in LEVELS], F.col("full_epochs").alias(full), F.col("cut").alias(cut))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    mine = {"domain": default_domain() if domain is None else domain, "lang": known("lang"), "source": known("source")}
    taken = docs.join(side, [mine[c] == F.col(names[c]) for c in LEVELS]).withColumn(copies, _copies(mix, full, cut)).where(F.col(copies) > 0)
    if mix.max_epochs > 1:
        taken = taken.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return taken.select(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """mix_report() over whole ``documents``; its docstring says what null, empty and repeated rows give."""
    return mix_report(table(spark, sf_dir, "documents"))


def _case(level: str, mix: Mix) -> str:
    return "CASE " + "".join(f"WHEN {level} = '{k}' THEN {v} " for k, v in mix.weights.get(level, {}).items()) + "ELSE 1 END" if mix.weights.get(level) else "1"


def mixing_ctes(docs: str, mix: Mix = PRODUCTION) -> str:
    """DuckDB CTEs that end in ``mixed`` (r, doc_id, domain, lang, source, n_tokens, leaf_budget, copies); r numbers the rows."""
    key = lambda epoch: f"CAST('0x' || substr(md5('{mix.seed}|' || {epoch} || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"
    out = f"""
named AS (SELECT row_number() OVER () AS r, doc_id,
  CASE WHEN regexp_extract(coalesce(source, ''), '^src(\\d{{1,9}})$', 1) = '' THEN 'other' ELSE 'domain' || CAST(CAST(regexp_extract(source, '^src(\\d{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain,
  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {docs}),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {mix.max_epochs} AS cap FROM named GROUP BY ALL),
given0 AS (SELECT CAST(floor(CAST(sum(tokens) * {mix.numerator} AS DOUBLE) / {mix.denominator}) AS DOUBLE) AS given FROM leaves)"""
    at: list[str] = []
    for i, level in enumerate(LEVELS):
        keys = ", ".join([*at, level])
        part = f"PARTITION BY {', '.join(at)} " if at else ""
        join = f"JOIN given{i} g USING ({', '.join(at)})" if at else "CROSS JOIN given0 g"
        out += f""",
n{i} AS (SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap, {_case(level, mix)} AS w FROM leaves GROUP BY {keys}),
a{i} AS (SELECT n.*, g.given, CAST(cap AS DOUBLE) / w AS ratio FROM n{i} n {join}),
b{i} AS (SELECT *, (given - CAST(coalesce(sum(cap) OVER ({part}ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
   / CAST(sum(w) OVER ({part}ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rise FROM a{i}),
given{i + 1} AS (SELECT {keys}, CASE WHEN ratio <= rise THEN CAST(cap AS DOUBLE) ELSE greatest(max(CASE WHEN ratio > rise THEN rise END) OVER ({part.strip()}), 0.0) * w END AS given FROM b{i})"""
        at.append(level)
    return out + f""",
budgets AS (SELECT l.*, CAST(floor(given) AS BIGINT) AS budget, CASE WHEN tokens > 0 THEN CAST(floor(given) AS BIGINT) // tokens ELSE 0 END AS fe FROM leaves l JOIN given3 USING (domain, lang, source)),
keyed AS (SELECT n.*, budget, fe, budget - fe * tokens AS rest, {key("CAST(fe AS VARCHAR)")} AS key FROM named n JOIN budgets USING (domain, lang, source)),
cum AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM keyed),
mixed AS (SELECT r, doc_id, domain, lang, source, n_tokens, budget AS leaf_budget, CAST(fe + CASE WHEN cum <= rest AND fe < {mix.max_epochs} THEN 1 ELSE 0 END AS BIGINT) AS copies FROM cum)"""


OP8_SQL = f"WITH {mixing_ctes('documents')} SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, copies FROM mixed"
