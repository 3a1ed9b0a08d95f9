"""Entity-graph analytics as Spark plans."""
