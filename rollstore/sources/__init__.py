"""Sources of records: TSV files, rows in memory, DataFrames."""
