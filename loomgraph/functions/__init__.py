"""Functions of the query language as Spark columns: all built-in, none in Python."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# ------------------------------------------------------------------ graph values
def id_of(name: str) -> Column:
    """id(n) of a node or relationship variable's struct column."""
    return F.col(f"{name}.id")


def labels(name: str) -> Column:
    return F.col(f"{name}.labels")


def type_of(name: str) -> Column:
    """type(r)."""
    return F.col(f"{name}.type")


def has_labels(name: str, *wanted: str) -> Column:
    """n:A:B as a predicate, without regard to case."""
    own = F.transform(labels(name), F.lower)
    out = F.lit(True)
    for x in wanted:
        out &= F.array_contains(own, x.lower())
    return out


def length(name: str) -> Column:
    """length(p): the number of edges of a path variable."""
    return F.col(f"{name}.depth")


def nodes(name: str) -> Column:
    """nodes(p): the ids that a path goes by, both ends among them."""
    return F.col(f"{name}.nodes")


def relationships(name: str) -> Column:
    """relationships(p): a path's edges in order, as structs of type and eid."""
    return F.col(f"{name}.rels")


def path_of(*names: str) -> Column:
    """p = (a)-[e]->(b)...: the path over node and relationship variables in turn, with the
    fields of a path variable."""
    ids, rels = [F.col(f"{n}.id") for n in names[::2]], [F.struct(F.col(f"{n}.type").alias("type"), F.col(f"{n}.eid").alias("eid")) for n in names[1::2]]
    eids = F.array(*[F.col(f"{n}.eid") for n in names[1::2]])
    return F.struct(ids[0].alias("start"), ids[-1].alias("end"), F.lit(len(rels)).alias("depth"), eids.alias("eids"), F.array(*rels).alias("rels"), F.array(*ids).alias("nodes"))


# ------------------------------------------------------------------ predicates
def exactly_one(items: Column | str, p: Predicate) -> Column:
    """SINGLE(x IN l WHERE p)."""
    return F.size(F.filter(_col(items), p)) == 1


def none(items: Column | str, p: Predicate) -> Column:
    return ~F.exists(_col(items), p)


def every(items: Column | str, p: Predicate) -> Column:
    return F.forall(_col(items), p)


def some(items: Column | str, p: Predicate) -> Column:
    return F.exists(_col(items), p)


def matches(c: Column | str, pattern: str) -> Column:
    """=~: the whole text matches."""
    return _col(c).rlike(rf"\A(?:{pattern})\z")


def xor(a: Column, b: Column) -> Column:
    return a != b


# ----------------------------------------------------------------------- lists
def comprehension(items: Column | str, where: Predicate | None = None, take: Predicate | None = None) -> Column:
    """[x IN l WHERE p | e]; FILTER without ``take``, EXTRACT without ``where``."""
    out = _col(items)
    out = F.filter(out, where) if where else out
    return F.transform(out, take) if take else out


def at(items: Column | str, k: int) -> Column:
    """l[k]; negative places count from the end; null beyond it."""
    return F.try_element_at(_col(items), F.lit(k + 1 if k >= 0 else k))


def part(items: Column | str, low: int = 0, high: int | None = None) -> Column:
    """l[low..high], as the query language cuts lists."""
    items, n = _col(items), F.size(_col(items))
    place = lambda k: F.greatest(F.lit(0), F.least(n, F.lit(k) if k >= 0 else n + k))
    lo, hi = place(low), n if high is None else place(high)
    return F.slice(items, lo + 1, F.greatest(F.lit(0), hi - lo))


def head(items: Column | str) -> Column:
    return at(items, 0)


def last(items: Column | str) -> Column:
    return at(items, -1)


def tail(items: Column | str) -> Column:
    return part(items, 1)


def span(low: Column | int, high: Column | int, step: int = 1) -> Column:
    """range(low, high[, step]), both ends within; empty where the step leads away."""
    low, high = _value(low), _value(high)
    fits = low <= high if step > 0 else low >= high
    return F.when(fits, F.sequence(low, high, F.lit(step))).otherwise(F.array().cast("array<int>"))


def unwind(items: Column | str, outer: bool = False) -> Column:
    """UNWIND: a row for each element, to be used in a select."""
    return F.explode_outer(_col(items)) if outer else F.explode(_col(items))


# ------------------------------------------------------------------- scalars
def case(subject: Column | str | None, *branches: tuple[Any, Any], otherwise: Any = None) -> Column:
    """CASE x WHEN v THEN r ... ELSE e END; without a subject the branches are conditions."""
    out = None
    for test, value in branches:
        test = _value(test) if subject is None else _col(subject) == _value(test)
        out = F.when(test, _value(value)) if out is None else out.when(test, _value(value))
    return out.otherwise(_value(otherwise))


def size(c: Column | str, text: bool = False) -> Column:
    """size(list), or size(text) with ``text``; null of null."""
    return F.char_length(_col(c)) if text else F.when(_col(c).isNotNull(), F.size(_col(c)))


def to_integer(c: Column | str) -> Column:
    """toInteger: null where the text is no number; fractions are cut.  Whole numbers keep
    every digit, others are read as doubles; null beyond 64 bits."""
    number = F.trim(_col(c).cast("string")).try_cast("double")
    # Exact where the text is digits; else the double's whole part.
    whole = F.when(_col(c).cast("string").rlike(r"\A\s*[+-]?\d+\s*\z"), F.trim(_col(c).cast("string")).try_cast("long"))
    cut = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    inside = (number >= -(2.0**63)) & (number < 2.0**63)
    return F.coalesce(whole, F.when(~_col(c).cast("string").rlike(r"\A\s*[+-]?\d+\s*\z") & inside, cut.cast("long")))


def to_float(c: Column | str) -> Column:
    return _col(c).try_cast("double")


def to_string(c: Column | str) -> Column:
    return _col(c).cast("string")


def to_lower(c: Column | str) -> Column:
    return F.lower(_col(c))


def to_upper(c: Column | str) -> Column:
    return F.upper(_col(c))
