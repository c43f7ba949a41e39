"""meshnet: cell tables to reactor networks, and corpus preparation, on Spark DataFrames."""
