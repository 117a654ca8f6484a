"""Spark-native analytics: compact table queries, interval joins, integer-set algebra and k-mer counting."""
