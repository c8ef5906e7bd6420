from .log_store import LogStore, live_view, run_summary
from .sorted_store import SortedStore

__all__ = ["LogStore", "SortedStore", "live_view", "run_summary"]
