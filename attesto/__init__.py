"""attesto: reconcile payment-file documents with Spark DataFrames."""
