"""Stateful operators on streams. Each has a batch twin in `operators.tracks` with the same results."""

from .stateful import (dedupe_requests, release_when_open, retry_budget_stream, ring_events_stream, stuck_stream, use_rocksdb)  # noqa: F401
