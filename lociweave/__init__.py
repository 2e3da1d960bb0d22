"""Spark-native analytics over ordered, labelled items grouped into contigs and genomes."""
