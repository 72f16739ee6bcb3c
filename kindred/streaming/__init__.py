"""Structured Streaming forms of queues and trackers; each gives what its batch form gives on the same rows."""

from .cancel import Cancelled, cancellable, flag_file
from .jobs import drain, listen, maintain
from .leases import lease_outcomes, leased_stream, throttled_stream
from .queues import accepted_stream, routed_stream
from .tracks import track_stream

__all__ = [
    "Cancelled", "accepted_stream", "cancellable", "drain", "flag_file", "lease_outcomes", "leased_stream", "listen", "maintain", "routed_stream", "throttled_stream",
    "track_stream",
]
