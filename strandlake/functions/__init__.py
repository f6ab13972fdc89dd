"""Fixed reference values and the small DataFrames made of them."""
