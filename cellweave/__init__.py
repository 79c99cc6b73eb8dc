"""Reshaping and analytics of ragged text tables on Spark DataFrames."""
