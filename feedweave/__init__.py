"""Record linkage and feed reconciliation on Spark DataFrames."""
