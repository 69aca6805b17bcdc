"""Spark-native document pipelines: sources, tools, flat-maps, count batches and windows, forks, taps, targets."""
