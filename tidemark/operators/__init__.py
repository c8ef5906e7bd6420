from .asof import asof, ceil, floor
from .intervals import merge_ranges, overlap_join
from .keyed import OrderedMap, OrderedSet
from .prefix import longest_prefix
from .replay import arena_append_slots, arena_get, arena_replay, stack_replay, stack_sizes
from .sequence import ListTable

__all__ = ["ListTable", "OrderedMap", "OrderedSet", "arena_append_slots", "arena_get", "arena_replay", "asof", "ceil", "floor", "longest_prefix", "merge_ranges", "overlap_join", "stack_replay", "stack_sizes"]
