"""A Spark-native engine for document-shaped queries: filters, pipelines, updates and change streams."""
