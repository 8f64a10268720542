"""Secret scan: three fixed patterns, and sliding-window Shannon entropy per character class.

Candidate strings are the maximal runs of a class's characters that are at least a window long. A window moves over
a candidate one character at a time; the counts of its characters and the sum of n*log2(n) over them are updated by
the character that enters and the one that leaves, so a step costs the same whatever the window. Windows at or
above the class's threshold are merged into spans. Candidates on the allow-list are skipped. DataFrame expressions only.

All steps are linear in the text. A long candidate is walked in stretches that overlap by all but one character of a
window, so no state grows with it; places are sums taken block by block; spans are merged by what stands before each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import table, text_of

# The patterns, and the least length of group or match that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")
#: Characters of a candidate that are walked at a time, and numbers that are summed at a time.
STRETCH, BLOCK = 256, 256


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``chars`` of ``window`` characters or more; a window is suspect from ``bits`` of entropy a character."""

    kind: str
    chars: str
    window: int
    bits: float
    allow: str


# Random hex of 20 characters has some 3.4 bits and random base-64 some 4.0; words in prose seldom pass 3.4.
CLASSES = (
    EntropyClass("entropy_hex", "[0-9a-fA-F]", 20, 2.9, r"^[0-9]+$|^[a-fA-F]+$|0123456789|^(.{1,4})\1+.{0,3}$"),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_-]", 20, 3.5, r"^[0-9a-fA-F]+$|^[A-Za-z/_-]+$|^[0-9/_-]+$|EXAMPLE|(?i:abcdefghij)|0123456789|^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"),
)


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is evaluated once; within a lambda a plain one is at each step."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sums_before(numbers: str) -> str:
    """SQL: for each number of an array<int> the sum of those before it. Blocks are summed first, then what is in them."""
    empty = "cast(array() AS array<int>)"
    blocks = f"transform(sequence(0, (size(n_) - 1) div {BLOCK}), b_ -> slice(n_, 1 + b_ * {BLOCK}, {BLOCK}))"
    running = lambda xs: f"aggregate({xs}, struct({empty} AS l, 0 AS s), (a_, x_) -> struct(concat(a_.l, array(a_.s)) AS l, a_.s + x_ AS s))"
    local = f"transform({blocks}, c_ -> {running('c_')})"
    whole = let("p_", local, f"flatten(zip_with(p_, {running('transform(p_, q_ -> q_.s)')}.l, (y_, z_) -> transform(y_.l, v_ -> v_ + z_)))")
    return let("n_", numbers, f"CASE WHEN size(n_) = 0 THEN {empty} ELSE {whole} END")


def located(text: str, pattern: str, found: str) -> str:
    """SQL: (start, len) of each match of ``pattern`` in column ``text``; ``found`` is the column of its matches.

    The pieces between the matches and the matches alternate, so a match starts where what stands before it ends.
    """
    pieces = f"transform(split({text}, {_quoted(pattern)}, -1), p -> length(p))"
    steps = f"zip_with(slice({pieces}, 1, size({found})), {found}, (p, m) -> p + length(m))"
    return f"""CASE WHEN size({found}) = 0 THEN cast(array() AS array<struct<start:int,len:int>>) ELSE
      zip_with({sums_before(steps)}, zip_with(slice({pieces}, 1, size({found})), {found}, (p, m) -> struct(p AS gap, length(m) AS len)),
        (s, x) -> struct(s + x.gap AS start, x.len AS len)) END"""


def _suspect(cls: EntropyClass) -> str:
    """SQL: lambda body over candidate ``c`` (start, string): spans whose windows reach the threshold."""
    w = cls.window
    part = lambda n: f"CASE WHEN {n} > 1 THEN {n} * log2({n}) ELSE 0D END"
    have, left = "coalesce(a.counts[e.comes], 0)", "a.counts[e.goes]"
    # Where one character comes and the same goes, nothing changes.
    same = "e.goes <=> e.comes"
    total = f"a.total + ({part(f'({have} + 1)')}) - ({part(have)}) + CASE WHEN e.goes IS NULL THEN 0D ELSE ({part(f'({left} - 1)')}) - ({part(left)}) END"
    counts = f"map_concat(map_filter(a.counts, (k, v) -> k <> e.comes AND NOT k <=> e.goes), map(e.comes, {have} + 1), CASE WHEN {left} > 1 THEN map(e.goes, {left} - 1) ELSE cast(map() AS map<string,int>) END)"
    entropy = f"(log2({w}) - a.total / {w})"
    hit = f"""CASE WHEN a.upto >= {w} AND round({entropy}, 9) >= {cls.bits}D THEN
        CASE WHEN size(a.spans) > 0 AND element_at(a.spans, -1).stop >= a.upto - {w}
        THEN concat(slice(a.spans, 1, size(a.spans) - 1), array(struct(element_at(a.spans, -1).start AS start, a.upto AS stop)))
        ELSE concat(a.spans, array(struct(a.upto - {w} AS start, a.upto AS stop))) END
      ELSE a.spans END"""
    events = f"transform(ch, (x, i) -> struct(x AS comes, CASE WHEN i >= {w} THEN ch[i - {w}] END AS goes))"
    # A step judges the window that the step before it has completed; the last one is judged at the end.
    walk = f"""aggregate({let('ch', "split(s, '')", events)},
      struct(cast(map() AS map<string,int>) AS counts, 0D AS total, 0 AS upto, cast(array() AS array<struct<start:int,stop:int>>) AS spans),
      (a, e) -> struct(CASE WHEN {same} THEN a.counts ELSE {counts} END AS counts, CASE WHEN {same} THEN a.total ELSE {total} END AS total, a.upto + 1 AS upto, {hit} AS spans),
      a -> {hit})"""
    pieces = f"regexp_extract_all(c.s, '.{{1,{STRETCH}}}', 0)"
    stretches = let("ps", pieces, f"transform(ps, (p, i) -> concat(p, coalesce(left(get(ps, i + 1), {w - 1}), '')))")
    spans = f"flatten(transform({stretches}, (s, i) -> transform({walk}, x -> struct(c.start + i * {STRETCH} + x.start AS start, c.start + i * {STRETCH} + x.stop AS stop))))"
    # A span that reaches the next one is one with it: runs begin where the span before ends earlier, and end before the next begins.
    heads = "filter(transform(sp, (x, i) -> CASE WHEN i = 0 OR sp[i - 1].stop < x.start THEN x.start END), y -> y IS NOT NULL)"
    tails = "filter(transform(sp, (x, i) -> CASE WHEN i = size(sp) - 1 OR x.stop < sp[i + 1].start THEN x.stop END), y -> y IS NOT NULL)"
    return let("sp", spans, f"zip_with({heads}, {tails}, (h, t) -> struct(h AS start, t AS stop))")


def _listing(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')")


SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def scan(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts of the fixed kinds, the digest of their spans, and all spans.

    ``found`` holds all spans as structs (start, rank, kind, stop), sorted. Null text counts as empty, and empty text has
    none. Texts and candidates of any length are read whole, in time that grows with them and no faster. A row is read
    by itself, so repeated rows get equal results; an empty table gives no rows; other columns are ignored.
    """
    out = docs.select("doc_id", text_of().alias("text"))
    out = out.select(
        "*",
        F.expr(f"regexp_extract_all(text, {_quoted(ASSIGN)}, 0)").alias("m_assign"),
        F.expr(f"regexp_extract_all(text, {_quoted(ASSIGN)}, 2)").alias("g_assign"),
        F.expr(f"regexp_extract_all(text, {_quoted(ACCESS)}, 0)").alias("m_access"),
        # A run of hex is a match whatever its length; short ones, each letter a-f of prose, only pass time.
        F.expr(f"regexp_extract_all(text, {_quoted(f'[0-9a-f]{{{HEX_LEAST},}}')}, 0)").alias("m_hex"),
        *[F.expr(f"regexp_extract_all(text, {_quoted(f'{c.chars}{{{c.window},}}')}, 0)").alias(f"m_{c.kind}") for c in classes],
    )
    out = out.select(
        "doc_id",
        F.expr(f"zip_with({located('text', ASSIGN, 'm_assign')}, g_assign, (x, g) -> struct(x.start AS start, 0 AS rank, 'assign' AS kind, CASE WHEN length(g) >= {ASSIGN_LEAST} THEN x.start + x.len END AS stop))").alias("assign"),
        F.expr(f"transform({located('text', ACCESS, 'm_access')}, x -> struct(x.start AS start, 1 AS rank, 'access' AS kind, CASE WHEN x.len >= {ACCESS_LEAST} THEN x.start + x.len END AS stop))").alias("access"),
        F.expr(f"transform({located('text', f'[0-9a-f]{{{HEX_LEAST},}}', 'm_hex')}, x -> struct(x.start AS start, 2 AS rank, 'hex' AS kind, x.start + x.len AS stop))").alias("hex"),
        *[F.expr(f"filter(zip_with({located('text', f'{c.chars}{{{c.window},}}', f'm_{c.kind}')}, m_{c.kind}, (x, s) -> struct(x.start AS start, s AS s)), c -> NOT c.s RLIKE {_quoted(c.allow)})").alias(c.kind) for c in classes],
    )
    out = out.select(
        "doc_id",
        *[F.expr(f"cast(filter({k}, s -> s.stop IS NOT NULL) AS {SPAN})").alias(k) for k in BASE_KINDS],
        *[F.expr(f"cast(transform(flatten(transform({c.kind}, c -> {_suspect(c)})), s -> struct(s.start AS start, {len(BASE_KINDS) + i} AS rank, '{c.kind}' AS kind, s.stop AS stop)) AS {SPAN})").alias(c.kind) for i, c in enumerate(classes)],
    )
    out = out.withColumn("base", F.array_sort(F.concat(*BASE_KINDS))).withColumn("found", F.array_sort(F.concat("base", *[c.kind for c in classes])))
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_listing("base"), 256).alias("base_sha256"),
        _listing("found").alias("spans"),
        "found",
    )


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """scan() over whole ``documents``; its docstring says what null, empty, very long and repeated rows give."""
    return scan(table(spark, sf_dir, "documents")).drop("found")


def _located_sql(kind: str, pattern: str, rank: int, keep: str) -> str:
    """DuckDB: (doc_id, s, m) of the matches of a pattern that pass ``keep``. Pieces and matches alternate, so a match starts where
    the lengths before it end."""
    return f"""x_{kind} AS (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS k FROM d),
p_{kind} AS (SELECT doc_id, unnest(string_split_regex(t, '{pattern}')) AS p, unnest(range(len(string_split_regex(t, '{pattern}')))) AS k FROM d WHERE regexp_matches(t, '{pattern}')),
l_{kind} AS (SELECT x.doc_id, x.k, x.m, CAST(sum(len(p.p)) OVER w + sum(len(x.m)) OVER w - len(x.m) AS BIGINT) AS s FROM x_{kind} x JOIN p_{kind} p ON p.doc_id = x.doc_id AND p.k = x.k WINDOW w AS (PARTITION BY x.doc_id ORDER BY x.k)),
f_{kind} AS (SELECT doc_id, s, {rank} AS rank, '{kind}' AS kind, s + len(m) AS stop, m FROM l_{kind} WHERE {keep})"""


def _entropy_sql(cls: EntropyClass, rank: int, allowed: str) -> str:
    """DuckDB: spans of windows over the threshold in candidates that are not on the allow-list."""
    w, k = cls.window, cls.kind
    return f"""{_located_sql(k + '_run', f'{cls.chars}{{{w},}}', rank, f'NOT ({allowed})')},
w_{k} AS (SELECT doc_id, s + i AS i, s AS c FROM (SELECT doc_id, s, m, unnest(range(len(m) - {w - 1})) AS i FROM f_{k}_run) WHERE round(list_entropy(string_split(m[i + 1 : i + {w}], '')), 9) >= {cls.bits}),
h_{k} AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, c ORDER BY i) <= {w} THEN 0 ELSE 1 END AS new FROM w_{k}),
g_{k} AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM h_{k}),
f_{k} AS (SELECT doc_id, min(i) AS s, {rank} AS rank, '{k}' AS kind, max(i) + {w} AS stop FROM g_{k} GROUP BY doc_id, c, g)"""


def op3_sql(docs: str = "documents") -> str:
    """DuckDB. Its expressions know no back-references, so runs that repeat up to four characters are told by rebuilding them."""
    assign = ASSIGN.replace("'", "''")
    again = " OR ".join(f"(len(m) - {r} >= {2 * n} AND (len(m) - {r}) % {n} = 0 AND m[1 : len(m) - {r}] = repeat(m[1 : {n}], (len(m) - {r}) // {n}))" for n in range(1, 5) for r in range(4))
    hex_allowed = f"regexp_matches(m, '^[0-9]+$|^[a-fA-F]+$|0123456789') OR {again}"
    kinds = [*BASE_KINDS, *[c.kind for c in CLASSES]]
    listing = "coalesce(string_agg(kind || ':' || s || ':' || stop, ',' ORDER BY s, rank, stop){where}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
{_located_sql('assign', assign, 0, f"len(regexp_extract(m, '{assign}', 2)) >= {ASSIGN_LEAST}")},
{_located_sql('access', ACCESS, 1, f'len(m) >= {ACCESS_LEAST}')},
{_located_sql('hex', HEX, 2, f'len(m) >= {HEX_LEAST}')},
{_entropy_sql(CLASSES[0], 3, hex_allowed)},
{_entropy_sql(CLASSES[1], 4, f"regexp_matches(m, '{CLASSES[1].allow}')")},
a AS ({' UNION ALL '.join(f'SELECT doc_id, s, rank, kind, stop FROM f_{k}' for k in kinds)}),
o AS (SELECT doc_id, {counts}, sha256({listing.format(where=' FILTER (WHERE rank < 3)')}) AS base_sha256, {listing.format(where='')} AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE_KINDS)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o ON o.doc_id = d.doc_id"""


OP3_SQL = op3_sql()
