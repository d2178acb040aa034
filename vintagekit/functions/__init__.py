"""Column-expression helpers (all JVM-side built-ins; no Python UDFs)."""

from vintagekit.functions.dates import (  # noqa: F401
    add_month_start, eom, month_diff, month_label, month_start, month_end_of,
)
from vintagekit.functions.nulls import (  # noqa: F401
    blank, flag, null_safe_ne, safe_div, sas_lt, sas_ge,
)
