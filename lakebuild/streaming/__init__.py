from .incremental import market_line_stream, stream_fact_market_history

__all__ = ["market_line_stream", "stream_fact_market_history"]
