"""How questions become DataFrames."""
