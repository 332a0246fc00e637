"""Column expressions shared by the operators. All run inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rating_from_quantity(quantity: Column) -> Column:
    """Quantity 1-50 as a grade 1-5."""
    return F.ceil(quantity / 10).cast("int")


def day_number(ts: Column) -> Column:
    """Calendar days since 1970-01-01."""
    return F.unix_date(ts.cast("date"))


def month_number(ts: Column) -> Column:
    """Calendar month as yyyymm."""
    return F.year(ts) * 100 + F.month(ts)


def tokens(text: Column) -> Column:
    """Lower-cased words between single blanks; empty ones are left in."""
    return F.split(F.lower(text), " ")
