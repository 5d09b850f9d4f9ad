"""Fitted models on a stream of new files."""

from lustra.streaming.apply import apply_models, write_stream

__all__ = ["apply_models", "write_stream"]
