"""Operators of a training-data pipeline: deduplication, filters, sharding, decontamination and tokens."""
