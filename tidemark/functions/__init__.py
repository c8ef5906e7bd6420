from .checks import check_key_type, check_size
from .prefixes import common_prefix_length
from .sequences import array_concat, array_get, array_index, array_insert_at, array_pop_back, array_pop_front, array_push_back, array_push_front, array_remove_at, array_set, array_split

__all__ = [
    "array_concat", "array_get", "array_index", "array_insert_at", "array_pop_back", "array_pop_front", "array_push_back", "array_push_front", "array_remove_at", "array_set", "array_split",
    "check_key_type", "check_size", "common_prefix_length",
]
