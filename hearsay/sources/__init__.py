"""Readers of the supported export layouts."""

from hearsay.sources.registry import read_source, register_source

__all__ = ["read_source", "register_source"]
