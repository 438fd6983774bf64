"""Collections and where they come from: DataFrames, Parquet tables, JSON requests, logs."""
