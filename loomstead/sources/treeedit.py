"""Minimum-cost edit scripts between trees of fields: add, delete, rename and move, judged by names, shapes and values."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache

STEP = "\x1f"
#: Spots per doubling of a number, in which the values of a field are counted.
SPOTS = 32
TEXTS, TEXT_SPOTS = 1_000_000, 256
#: Cost of deleting or adding one field. Taking one field for another costs the distance of their names (0 to 1)
#: plus that of their values (0 to 1), so two fields that agree in neither are never one; a move costs MOVE besides.
HALF = 0.625
MOVE = 0.25
UNKNOWN = 0.5


@lru_cache(maxsize=100_000)
def spot(value: str | float | bool) -> int:
    """The place of a value in the histogram of its field: numbers and texts of numbers by magnitude, other texts by hash."""
    if isinstance(value, bool):
        return TEXTS + int(value)
    if isinstance(value, str):
        text = value.strip().removesuffix("%").rstrip()
        try:
            number = float(text)
        except ValueError:
            return TEXTS + zlib.crc32(" ".join(value.lower().split()).encode("utf-8", "replace")) % TEXT_SPOTS
    else:
        number = float(value)
    if not math.isfinite(number):
        return TEXTS + TEXT_SPOTS
    return int(math.copysign(math.floor(math.log2(1 + abs(number)) * SPOTS), number))


def value_distance(a: Mapping[int, int], b: Mapping[int, int]) -> float:
    """0 to 1: how far two histograms are apart; UNKNOWN if one is empty, and drawn towards it by the weight of one value.

    Numbers by the mean shift in doublings (the area between the cumulated shares), other texts by the
    share that differs, and the difference of the shares of numbers.
    """
    all_a, all_b = sum(a.values()), sum(b.values())
    few = min(all_a, all_b)
    if not few:
        return UNKNOWN
    num_a, num_b = (sum(n for s, n in h.items() if s < TEXTS) for h in (a, b))
    share_a, share_b = num_a / all_a, num_b / all_b
    if not num_a and not num_b:
        off = sum(abs(a.get(s, 0) / all_a - b.get(s, 0) / all_b) for s in {*a, *b}) / 2
    else:
        area = 0.0
        if num_a and num_b:
            places = sorted(s for s in {*a, *b} if s < TEXTS)
            till_a = till_b = 0
            for here, after in zip(places, places[1:]):
                till_a, till_b = till_a + a.get(here, 0), till_b + b.get(here, 0)
                area += abs(till_a / num_a - till_b / num_b) * (after - here)
        off = min(1.0, abs(share_a - share_b) + min(1.0, area / SPOTS) * min(share_a, share_b))
    return (few * off + UNKNOWN) / (few + 1)


@lru_cache(maxsize=100_000)
def letters(name: str) -> str:
    """The letters and digits of a name in lower case."""
    return "".join(c for c in name.lower() if c.isalnum())


@lru_cache(maxsize=200_000)
def name_distance(a: str, b: str) -> float:
    """0 to 1 by the longest common subsequence of letters, so 0 if only letter case and separators differ.

    Names that both carry numbers, and other ones, are codes of different things, which no agreement of values makes one: 2.
    """
    x, y = letters(a), letters(b)
    if x == y:
        return 0.0
    digits_x, digits_y = re.findall(r"\d+", x), re.findall(r"\d+", y)
    if digits_x and digits_y and digits_x != digits_y:
        return 2.0
    best = [0] * (len(y) + 1)
    for c in x:
        corner = 0
        for j, d in enumerate(y, 1):
            corner, best[j] = best[j], corner + 1 if c == d else max(best[j], best[j - 1])
    return 1 - 2 * best[-1] / (len(x) + len(y))


def assign(cost: Sequence[Sequence[float]]) -> list[int]:
    """The column of each row in an assignment of least total cost; there are at least as many columns as rows."""
    n, m = len(cost), len(cost[0]) if cost else 0
    of_row, of_col = [0.0] * (n + 1), [0.0] * (m + 1)
    row_at, came = [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_at[0], at = i, 0
        slack, done = [math.inf] * (m + 1), [False] * (m + 1)
        while row_at[at]:
            done[at], row, least, to = True, row_at[at], math.inf, 0
            for j in range(1, m + 1):
                if not done[j]:
                    rest = cost[row - 1][j - 1] - of_row[row] - of_col[j]
                    if rest < slack[j]:
                        slack[j], came[j] = rest, at
                    if slack[j] < least:
                        least, to = slack[j], j
            for j in range(m + 1):
                if done[j]:
                    of_row[row_at[j]] += least
                    of_col[j] -= least
                else:
                    slack[j] -= least
            at = to
        while at:
            row_at[at] = row_at[came[at]]
            at = came[at]
    out = [-1] * n
    for j in range(1, m + 1):
        if row_at[j]:
            out[row_at[j] - 1] = j - 1
    return out


class Field:
    """A field of a schema with the fields below it, the kinds of values it held, and its values' histogram."""

    __slots__ = ("name", "path", "kids", "kinds", "_spots")

    def __init__(self, name: str, path: str) -> None:
        self.name, self.path, self.kids, self.kinds, self._spots = name, path, {}, frozenset(), ""

    @property
    def spots(self) -> dict[int, int]:
        """The histogram, read when it is first asked for: most fields keep their names and are never compared by value."""
        if isinstance(self._spots, str):
            self._spots = {int(s): int(n) for s, n in (c.split(":") for c in self._spots.split(",") if c)}
        return self._spots

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids.values())

    def walk(self) -> Iterable[Field]:
        yield self
        for k in self.kids.values():
            yield from k.walk()

    def value_kind(self) -> str | None:
        """text or number if the non-null values are all of it, else another word; None without non-null values."""
        seen = self.kinds - {"null"}
        return None if not seen else next(iter(seen)) if len(seen) == 1 else "mixed"


def field_tree(fields: Iterable[tuple[str, str, str]]) -> Field:
    """The tree of a file's (path, kinds, spots): kinds joined by commas, spots as spot:count joined by commas."""
    root = Field("", "")
    for path, kinds, spots in fields:
        node = root
        for step in path.split(STEP):
            below = f"{node.path}{STEP}{step}" if node.path else step
            node = node.kids.setdefault(step, Field(step, below))
        node.kinds, node._spots = frozenset(kinds.split(",")), spots
    return root


Step = tuple[str, str, "str | None"]


def _relabel(a: Field, b: Field) -> float:
    """Cost of taking one field for another, without the fields below them."""
    if bool(a.kids) != bool(b.kids):
        return math.inf
    return name_distance(a.name, b.name) + (UNKNOWN if a.kids else value_distance(a.spots, b.spots))


def _own(a: Field, b: Field) -> list[Step]:
    return [("retyped", b.path, a.path)] if {a.value_kind(), b.value_kind()} == {"text", "number"} else []


def edit_script(
    old: Field, new: Field, apart: frozenset[tuple[str, str]] = frozenset(), likely: set[tuple[str, str]] | None = None
) -> tuple[float, list[Step]]:
    """Script (kind, new path, old path) of least cost that turns the fields below old into those below new.

    A field of the same name costs nothing and is met first, as names and values are distances. The others
    are assigned as a whole, each to another one, at the cost of taking it for that one and of editing what
    is below, or to nothing, at HALF for each field of it; pairs of paths in apart are never one field. What
    is left over then is matched across the tree as moves. likely, if given, takes up all pairs of other
    names that are worth a match, chosen or not.
    """
    cost, script, gone, came = _edit(old, new, apart, likely)

    def price(a: Field, b: Field) -> float:
        if a.kids or b.kids or letters(a.name) != letters(b.name) and (a.path, b.path) in apart:
            return math.inf
        return MOVE + _relabel(a, b)

    for a, b in _match(gone, came, price, likely):
        cost += MOVE + _relabel(a, b) - 2 * HALF
        script += [("moved", b.path, a.path), *_own(a, b)]
        gone.remove(a), came.remove(b)
    script += [("removed", a.path, a.path) for a in gone] + [("added", b.path, None) for b in came]
    return cost, script


def _match(left: Sequence[Field], right: Sequence[Field], price: Callable[[Field, Field], float], likely: set | None) -> list[tuple[Field, Field]]:
    """Pairs of an assignment of least cost, in which every field may also stay alone."""
    left, right = sorted(left, key=lambda f: f.path), sorted(right, key=lambda f: f.path)
    if not left or not right:
        return []
    prices = [[price(a, b) for b in right] for a in left]
    # adding what stays alone on the right is paid in advance, so leaving it unmatched costs nothing more
    rows = [[p - HALF * b.size() if p < HALF * (a.size() + b.size()) else math.inf for p, b in zip(line, right)] for a, line in zip(left, prices)]
    if likely is not None:
        likely |= {(a.path, b.path) for a, line in zip(left, rows) for b, p in zip(right, line) if p < math.inf}
    live = [i for i, line in enumerate(rows) if any(p < math.inf for p in line)]
    rows = [[p if p < math.inf else 1e9 for p in rows[i]] + [HALF * left[i].size() if i == k else 1e9 for k in live] for i in live]
    return [(left[i], right[j]) for i, j in zip(live, assign(rows)) if j < len(right)]


def _edit(old: Field, new: Field, apart: frozenset, likely: set | None) -> tuple[float, list[Step], list[Field], list[Field]]:
    """Cost, script, and the fields that are left over on either side, at any depth."""
    cost, script, gone, came = 0.0, [], [], []
    below: dict[tuple[str, str], tuple] = {}

    def price(a: Field, b: Field) -> float:
        own = math.inf if (a.path, b.path) in apart and letters(a.name) != letters(b.name) else _relabel(a, b)
        if own < math.inf:
            below[a.path, b.path] = deep = _edit(a, b, apart, likely)
            own += deep[0]
        return own

    same = [(a, new.kids[n]) for n, a in old.kids.items() if n in new.kids]
    left = [a for n, a in old.kids.items() if n not in new.kids]
    right = [b for n, b in new.kids.items() if n not in old.kids]
    met = _match(left, right, price, likely)
    for a, b in met:
        cost += _relabel(a, b)
        script.append(("renamed", b.path, a.path))
    for a, b in [*same, *met]:
        deep = below.get((a.path, b.path)) or _edit(a, b, apart, likely)
        cost += deep[0]
        script += [*_own(a, b), *deep[1]]
        gone, came = gone + deep[2], came + deep[3]
    taken = {id(f) for pair in met for f in pair}
    for side, out in ((left, gone), (right, came)):
        alone = [x for f in side if id(f) not in taken for x in f.walk()]
        cost += HALF * len(alone)
        out += alone
    return cost, script, gone, came
