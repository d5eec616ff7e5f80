"""Operators for preparing training data for language models, at the scale of a whole corpus."""
