"""Operators for preparing language-model training corpora; one module per operator."""
