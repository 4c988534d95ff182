"""Operators of a training-data pipeline: dedup, decontamination, quality, PII, mixing and more."""
