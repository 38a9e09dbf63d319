"""inkstone: a Spark-native writing-audit and text-corpus analytics engine."""
