"""idloom: Spark-native registry of typed, versioned JSON documents."""
