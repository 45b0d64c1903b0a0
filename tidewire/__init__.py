"""News, community and market data operators for Spark."""
