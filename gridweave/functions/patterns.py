"""Row patterns: a small parser and a backtracking matcher over rows whose conditions are known.

The language is that of SQL's row pattern recognition: names, concatenation, |, groups, the quantifiers * + ? {n},
{n,}, {n,m} and {,m} with an optional ? for reluctant, PERMUTE(...), exclusion {- ... -}, and the anchors ^ and $.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations
from typing import Any

TOKEN = re.compile(r"\s*(?:(\{-)|(-\})|(PERMUTE)\b|([A-Za-z_]\w*)|\{\s*(\d*)\s*(,?)\s*(\d*)\s*\}|([()|*+?^$,]))")


def tokens(pattern: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    pattern = pattern.strip()
    while at < len(pattern):
        m = TOKEN.match(pattern, at)
        if not m:
            raise ValueError(f"pattern: cannot read {pattern[at:]!r}")
        opens, closes, permute, name, low, comma, high, sign = m.groups()
        if opens:
            out.append(("{-", None))
        elif closes:
            out.append(("-}", None))
        elif permute:
            out.append(("PERMUTE", None))
        elif name:
            out.append(("name", name))
        elif sign:
            out.append((sign, None))
        else:
            if not low and not comma:
                raise ValueError("pattern: empty quantifier")
            out.append(("repeat", (int(low or 0), (int(high) if high else None) if comma else int(low))))
        at = m.end()
    return out


def parse(pattern: str) -> tuple:
    """A tree of ("name", x), ("seq", [..]), ("or", [..]), ("repeat", x, low, high, greedy), ("not", x), ("^",), ("$",)."""
    todo = tokens(pattern)
    at = 0

    def peek() -> str | None:
        return todo[at][0] if at < len(todo) else None

    def take(kind: str) -> Any:
        nonlocal at
        if peek() != kind:
            raise ValueError(f"pattern: expected {kind}")
        at += 1
        return todo[at - 1][1]

    def either() -> tuple:
        options = [sequence()]
        while peek() == "|":
            take("|")
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence() -> tuple:
        parts = []
        while peek() not in (None, "|", ")", "-}", ","):
            parts.append(repeated())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def repeated() -> tuple:
        x = atom()
        while peek() in ("*", "+", "?", "repeat"):
            kind = peek()
            bounds = take(kind)
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(kind, bounds)
            greedy = True
            if peek() == "?":
                take("?")
                greedy = False
            x = ("repeat", x, low, high, greedy)
        return x

    def atom() -> tuple:
        kind = peek()
        if kind == "name":
            return ("name", take("name"))
        if kind == "(":
            take("(")
            x = either()
            take(")")
            return x
        if kind == "{-":
            take("{-")
            x = either()
            take("-}")
            return ("not", x)
        if kind == "PERMUTE":
            take("PERMUTE")
            take("(")
            parts = [either()]
            while peek() == ",":
                take(",")
                parts.append(either())
            take(")")
            return ("or", [("seq", list(p)) for p in permutations(parts)])
        if kind in ("^", "$"):
            take(kind)
            return (kind,)
        raise ValueError(f"pattern: unexpected {kind}")

    tree = either()
    if peek() is not None:
        raise ValueError(f"pattern: unexpected {peek()}")
    return tree


def names_of(tree: tuple) -> list[str]:
    if tree[0] == "name":
        return [tree[1]]
    inner = tree[1] if tree[0] in ("seq", "or") else [tree[1]] if tree[0] in ("repeat", "not") else []
    return list(dict.fromkeys(n for x in inner for n in names_of(x)))


def anchored(tree: tuple, anchor: str) -> bool:
    inner = tree[1] if tree[0] in ("seq", "or") else [tree[1]] if tree[0] in ("repeat", "not") else []
    return tree[0] == anchor or any(anchored(x, anchor) for x in inner)


def within_run(tree: tuple, first: bool, last: bool) -> tuple:
    """The tree for a run of a partition's rows: ^ holds in the first run only, $ in the last only."""
    if tree[0] in ("seq", "or"):
        return tree[0], [within_run(x, first, last) for x in tree[1]]
    if tree[0] in ("repeat", "not"):
        return tree[0], within_run(tree[1], first, last), *tree[2:]
    if (tree[0] == "^" and not first) or (tree[0] == "$" and not last):
        return "or", []
    return tree


Step = tuple[int, str, bool]  # row, variable, left out of the output
Holds = Callable[[str, int, Sequence[Step]], bool]


def _match(tree: tuple, at: int, taken: tuple[Step, ...], n: int, holds: Holds, out: bool, fits: Callable[[int], bool]) -> Iterator[tuple[int, tuple[Step, ...]]]:
    """All ways to match from row ``at``, the preferred first."""
    kind = tree[0]
    if kind == "name":
        if at < n and fits(at) and holds(tree[1], at, taken):
            yield at + 1, (*taken, (at, tree[1], out))
    elif kind == "seq":
        yield from _sequence(tree[1], 0, at, taken, n, holds, out, fits)
    elif kind == "or":
        for option in tree[1]:
            yield from _match(option, at, taken, n, holds, out, fits)
    elif kind == "not":
        yield from _match(tree[1], at, taken, n, holds, True, fits)
    elif kind == "repeat":
        yield from _repeat(tree, 0, at, taken, n, holds, out, fits)
    elif (kind == "^" and at == 0) or (kind == "$" and at == n):
        yield at, taken


def _sequence(parts, k, at, taken, n, holds, out, fits):
    if k == len(parts):
        yield at, taken
        return
    for end, got in _match(parts[k], at, taken, n, holds, out, fits):
        yield from _sequence(parts, k + 1, end, got, n, holds, out, fits)


def _repeat(tree, done, at, taken, n, holds, out, fits):
    """A stack in place of recursion where the inner part is one name, so that long runs are no depth."""
    _, inner, low, high, greedy = tree
    if inner[0] == "name":
        ends = [(at, taken)] if low == 0 else []
        count = 0
        while (high is None or count < high) and at < n and fits(at) and holds(inner[1], at, taken):
            taken = (*taken, (at, inner[1], out))
            at, count = at + 1, count + 1
            if count >= low:
                ends.append((at, taken))
        yield from reversed(ends) if greedy else ends
        return
    enough = done >= low
    if enough and not greedy:
        yield at, taken
    if high is None or done < high:
        for end, got in _match(inner, at, taken, n, holds, out, fits):
            if end > at or done < low:
                yield from _repeat(tree, done + 1, end, got, n, holds, out, fits)
    if enough and greedy:
        yield at, taken


def find_all(tree: tuple, n: int, holds: Holds, times: Sequence[int], within: int, skip: str = "PAST LAST ROW", subsets: dict[str, Sequence[str]] | None = None) -> list[list[Step]]:
    """Matches in order, none spanning more than ``within`` ticks; empty ones are passed over."""
    found, at = [], 0
    while at < n:
        limit = times[at] + within
        first = next((got for end, got in _match(tree, at, (), n, holds, False, lambda i, limit=limit: times[i] <= limit) if end > at), None)
        if first is None:
            at += 1
            continue
        found.append(list(first))
        if skip == "PAST LAST ROW":
            at = first[-1][0] + 1
        elif skip == "TO NEXT ROW":
            at += 1
        else:
            m = re.fullmatch(r"TO (FIRST|LAST) (\w+)", skip)
            if not m:
                raise ValueError(f"no skip rule {skip}")
            members = (subsets or {}).get(m[2], (m[2],))
            rows = [i for i, v, _ in first if v in members]
            if not rows:
                raise ValueError(f"skip: {m[2]} matched no row")
            to = rows[0] if m[1] == "FIRST" else rows[-1]
            if to == at:
                raise ValueError("skip: to the first row of the match")
            at = max(to, at + 1)
    return found
