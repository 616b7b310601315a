"""tessera: Spark-native analysis of graphs of named entities."""
