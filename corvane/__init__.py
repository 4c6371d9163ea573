"""Corvane: DataFrame operators for curating paired corpora and judging detectors."""

__version__ = "0.1.0"
