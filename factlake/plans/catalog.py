"""Imports every query module, which fills the registry."""

from . import replies, retrieval, routing, sources, state, streams, text  # noqa: F401
