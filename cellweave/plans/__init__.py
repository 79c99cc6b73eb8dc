"""Jobs built from operators: typed records, the trade table, extraction runs."""
