"""Operators of a text-corpus pipeline: extraction, quality, duplicates, mixing, scoring, packing, search."""
