"""Column-parameterised operators on DataFrames."""
