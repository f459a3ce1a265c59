"""Keeping costly columns from being computed again by the filters above them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluate_once(**columns: Column) -> Column:
    """Columns for a select, computed once per row.

    A filter on an ordinary column is moved below the projection that computes it and so computes
    it again; a filter on a generator's output stays above.
    """
    return F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
