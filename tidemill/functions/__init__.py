from tidemill.functions.cleaning import (
    any_nonzero,
    castable_to_int,
    null_to,
    size_letter,
)
from tidemill.functions.dates import in_two_year_window, month_label, previous_month_label

__all__ = [
    "any_nonzero",
    "castable_to_int",
    "in_two_year_window",
    "month_label",
    "null_to",
    "previous_month_label",
    "size_letter",
]
