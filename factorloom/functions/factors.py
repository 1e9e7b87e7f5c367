"""Factor functions as native expressions over the array of satisfied positions.

sat[i] is whether variable i of a factor has the value that the factor asks for; the last position is
the head, the others are the body. Every function is short-circuiting higher-order SQL, so potentials
stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.schema import FUNCTIONS

_same = lambda x: x


def head(sat: Column) -> Column:
    return F.element_at(sat, -1)


def body(sat: Column) -> Column:
    """All positions but the last; empty for one variable."""
    return F.slice(sat, F.lit(1), F.size(sat) - 1)


def body_holds(sat: Column) -> Column:
    return F.forall(body(sat), _same)


def satisfied_rules(sat: Column) -> Column:
    """How many body positions imply the head; for one variable, whether the head holds."""
    many = F.size(F.filter(body(sat), lambda s: ~s | head(sat)))
    return F.when(F.size(sat) == 1, head(sat).cast("int")).otherwise(many)


def imply_natural(sat: Column) -> Column:
    return F.when(~body_holds(sat), 0.0).when(head(sat), 1.0).otherwise(-1.0)


def imply_mln(sat: Column) -> Column:
    return F.when(~body_holds(sat) | head(sat), 1.0).otherwise(0.0)


def either(sat: Column) -> Column:
    return F.when(F.exists(sat, _same), 1.0).otherwise(-1.0)


def every(sat: Column) -> Column:
    return F.when(F.forall(sat, _same), 1.0).otherwise(-1.0)


def equal(sat: Column) -> Column:
    return F.when(F.size(F.array_distinct(sat)) == 1, 1.0).otherwise(-1.0)


def linear(sat: Column) -> Column:
    return satisfied_rules(sat).cast("double")


def ratio(sat: Column) -> Column:
    return F.log2(1.0 + satisfied_rules(sat))


def logical(sat: Column) -> Column:
    return F.when(satisfied_rules(sat) > 0, 1.0).otherwise(0.0)


def and_categorical(sat: Column) -> Column:
    return F.when(F.forall(sat, _same), 1.0).otherwise(0.0)


BY_NAME = {
    "imply_natural": imply_natural, "or": either, "and": every, "equal": equal, "istrue": every, "linear": linear, "ratio": ratio,
    "logical": logical, "and_categorical": and_categorical, "imply_mln": imply_mln,
}


def factor_value(func: Column, sat: Column) -> Column:
    """Value by function code; an unknown code or a factor without variables is an error."""
    chain = F.when(F.size(sat) < 1, F.raise_error(F.lit("a factor needs a variable")).cast("double"))
    for name, code in FUNCTIONS.items():
        chain = chain.when(func == code, BY_NAME[name](sat))
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown factor function "), func.cast("string"))).cast("double"))
