"""Operators on texts and typed names for training-data preparation. Nothing outside this package imports it."""
