"""Structured Streaming form of the daily resample.

The reference reads one uploaded file and has no streaming operators; this
package only lets the same daily aggregation run incrementally on a stream."""

from .daily import daily_means_stream, start_daily_means

__all__ = ["daily_means_stream", "start_daily_means"]
