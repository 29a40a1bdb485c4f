"""Operators of a training-data pipeline: sharding, decontamination, scoring, extraction, tokens and deduplication."""
