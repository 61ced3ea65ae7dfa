from tidemill.streaming.apply import (
    Target,
    apply_batch,
    stream_into_one,
    stream_into_many,
    stream_per_table,
)
from tidemill.streaming.deliveries import first_deliveries, late_events
from tidemill.streaming.envelope import (
    decode,
    row_image,
    typed_changes,
    with_event_time,
)
from tidemill.streaming.variant import parsed, variant_changes

__all__ = [
    "Target",
    "apply_batch",
    "decode",
    "first_deliveries",
    "late_events",
    "parsed",
    "row_image",
    "stream_into_many",
    "stream_into_one",
    "stream_per_table",
    "typed_changes",
    "variant_changes",
    "with_event_time",
]
