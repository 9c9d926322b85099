"""Spark-native comparison of document artwork: images, boxes, text lines and alignments as DataFrames."""
