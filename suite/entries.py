"""Imports every module that registers queries."""

from suite import bias, plans, profile, quality, registry, rules, sources, streams, training  # noqa: F401
