from .manifest import Files, Manifest, Run
from .strategies import CompactionStrategy, Leveled, MergeJob, SizeTiered, ranges_overlap, register_strategy

__all__ = ["CompactionStrategy", "Files", "Leveled", "Manifest", "MergeJob", "Run", "SizeTiered", "ranges_overlap", "register_strategy"]
