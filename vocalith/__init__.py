"""vocalith: a Spark-native engine that learns the voice of a corpus and measures what departs from it."""
