from eodscan.streaming.ingest import stream_days, with_headers

__all__ = ["stream_days", "with_headers"]
