"""runloom: analytics over agent runs and large text corpora, as Spark DataFrame operators."""

__version__ = "0.1.0"
