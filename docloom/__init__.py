"""docloom: Spark-native retrieval and analytics over crawled documentation."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
