"""Event-sourced order-book analytics on Spark DataFrames."""
