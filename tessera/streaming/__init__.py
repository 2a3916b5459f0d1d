"""Streaming use of the stateless operators.

The reference has no streams; its per-row steps (flags, encoding, scoring, threshold)
are plain column expressions, so they run unchanged on a streaming DataFrame.
"""

from .score_stream import score_stream  # noqa: F401
