"""quillon: vector, property-graph and similarity analytics expressed as Spark DataFrames."""
