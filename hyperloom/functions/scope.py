"""Scoped terms as text in a column: alpha conversion and equality, in the JVM.

A variable is ``$`` and a word. A term's canonical form numbers its variables by their first
appearance, so terms that differ by names only are equal, and can be joined by equality.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VARIABLE = r"\$\w+"


def variables(term: Column) -> Column:
    """The variables of a term, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(term, F.lit(f"({_VARIABLE})"), F.lit(1)))


def is_closed(term: Column) -> Column:
    return ~F.coalesce(F.rlike(term, F.lit(_VARIABLE)), F.lit(True))


def canonical(term: Column) -> Column:
    """The term with its variables as #0, #1 and so on."""
    names = variables(term)
    # cut at the variables, and put each one's number in their places
    pieces = F.split(term, _VARIABLE, -1)
    found = F.regexp_extract_all(term, F.lit(f"({_VARIABLE})"), F.lit(1))
    numbers = F.transform(found, lambda v: F.concat(F.lit("#"), (F.array_position(names, v) - 1).cast("string")))
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(numbers, i), F.lit("")))), "")


def alpha_equal(a: Column, b: Column) -> Column:
    return canonical(a) == canonical(b)


def substitute(term: Column, name: str, by: Column) -> Column:
    """The term with a column in place of the variable ``name``; text in double quotes is quoted and stays."""
    quoted = F.split(term, '"', -1)
    swapped = F.transform(quoted, lambda p, i: F.when(i % 2 == 0, F.call_function("array_join", F.split(p, rf"\${name}(?!\w)", -1), by)).otherwise(p))
    return F.array_join(swapped, '"')
