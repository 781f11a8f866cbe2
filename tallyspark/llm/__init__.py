"""Operators of a training-data pipeline: packing, language, PII, search, toxicity, joins, dedup, chat, BPE."""
