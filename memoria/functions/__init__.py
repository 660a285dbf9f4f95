"""Native column expressions (no Python UDFs) shared by the operators."""
from .timefn import as_of_lit, days_between, plus_days, plus_hours, seconds_between  # noqa: F401
from .textfn import contains_any, summary_or_truncate, preview  # noqa: F401
