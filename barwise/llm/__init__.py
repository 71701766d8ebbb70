"""Operators for preparing training text: dedup, quality, language, scoring, mixing and token output."""
