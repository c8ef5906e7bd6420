from .upserts import latest_stream, write_stream

__all__ = ["latest_stream", "write_stream"]
