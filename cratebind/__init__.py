"""Record linkage of ordered, loosely described items against a library, as Spark DataFrame operators."""
