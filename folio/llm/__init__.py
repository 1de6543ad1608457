"""Operators for preparing language-model training corpora, and their queries."""
