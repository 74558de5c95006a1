from .fixed_width import (field_columns, parse_fixed_width, record_type, rejected_counts, slice_field,
                          tolerant_cast, trim_field)
from .scalars import (concat_keys, iso_text, open_end, parse_date, parse_timestamp,
                      version_key)

__all__ = [
    "field_columns", "parse_fixed_width", "record_type", "rejected_counts", "slice_field", "tolerant_cast",
    "trim_field", "concat_keys", "iso_text", "open_end", "parse_date", "parse_timestamp",
    "version_key",
]
