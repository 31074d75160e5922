"""basalt: a small relational engine and keyed-table API on PySpark DataFrames."""
