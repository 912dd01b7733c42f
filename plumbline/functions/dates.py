"""Date parsing with an explicit, ordered list of formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried in this order for text columns; the first that parses wins.
DEFAULT_FORMATS = (
    "yyyy-M-d HH:mm:ss", "yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d",
)


def parse_date(c: Column, data_type: str, formats: tuple[str, ...] = DEFAULT_FORMATS) -> Column:
    """Timestamp without zone, or NULL when no format fits."""
    if data_type.startswith("timestamp") or data_type == "date":
        return c.cast("timestamp_ntz")
    text = F.trim(c.cast("string"))
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def moment(value: str | None) -> Column:
    """A fixed point in time, or now when none is given."""
    c = F.current_timestamp() if value is None else F.lit(value)
    return c.cast("timestamp_ntz")
