"""tidemark: Spark-native market, document and risk analytics."""
