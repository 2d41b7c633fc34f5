"""Financial-records evidence engine on Spark: every operator takes and returns DataFrames."""
