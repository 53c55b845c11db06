"""Operators that prepare training corpora: formatting, scoring, cleaning, deduplication, mixing."""
