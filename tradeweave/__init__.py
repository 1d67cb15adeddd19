"""tradeweave: a Spark engine for supplier-network graphs."""
