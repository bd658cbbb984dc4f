"""Filters, quantifiers, list reductions, upserts and validation on DataFrames."""
