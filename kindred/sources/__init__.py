"""Tables that the operators read."""

from .files import bundle_listing, legacy_store, media, pack, queue_stream
from .tables import artifacts, boxes, candidates, cluster_input, events, frames, messages, observations, sessions, table

__all__ = [
    "artifacts", "boxes", "bundle_listing", "candidates", "cluster_input", "events", "frames", "legacy_store", "media", "messages", "observations",
    "pack", "queue_stream", "sessions", "table",
]
