"""freshet: Spark-native analytics over ensembles of daily river-basin model output."""
