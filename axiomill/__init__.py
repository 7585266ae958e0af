"""axiomill: a Spark-native engine for deductive queries and corpus preparation."""
