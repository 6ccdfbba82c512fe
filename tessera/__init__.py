"""Tessera: analytics over record graphs and tables, and over training data, as Spark DataFrame programs."""
