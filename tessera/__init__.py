"""Group-aware, refusal-first analytics on PySpark DataFrames."""
