"""Trading-research analytics on Spark: bars, trades, deals and candidate returns as DataFrame transformations."""
