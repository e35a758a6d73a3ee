"""Selection-amplification analytics on Spark DataFrames."""
