"""Point-in-time ledger features, sampling, scoring and run artifacts on Spark DataFrames."""
