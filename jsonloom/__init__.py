"""jsonloom: semi-structured JSON analytics on PySpark DataFrames."""
