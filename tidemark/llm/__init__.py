"""Training-data operators: ten text and vector jobs over DataFrames."""
