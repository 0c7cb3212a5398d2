"""Games in streams."""

from .games import replay_stream, windowed_outcomes

__all__ = ["replay_stream", "windowed_outcomes"]
