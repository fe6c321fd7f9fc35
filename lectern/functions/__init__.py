"""Scalar functions as Column -> Column: text, catalogue and media."""
