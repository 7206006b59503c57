"""A name for a value within an expression.

An expression used n times in another stands in the plan n times, and nested uses multiply until
generated code no longer compiles. Bound as a lambda's argument it stands there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)
