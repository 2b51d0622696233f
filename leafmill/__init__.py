"""leafmill: a Spark-native document analytics and evidence retrieval library."""
