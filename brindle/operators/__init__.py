"""Market operators over DataFrames."""
