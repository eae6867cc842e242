"""Daily-bar market analytics on PySpark DataFrames."""
