from .batches import tag_batch, union_batches
from .flags import is_low_grade
from .history import as_of, current_only, with_validity
from .lookup import resolve_reference
from .temporal import point_in_time_join

__all__ = ["tag_batch", "union_batches", "is_low_grade", "as_of", "current_only",
           "with_validity", "resolve_reference", "point_in_time_join"]
