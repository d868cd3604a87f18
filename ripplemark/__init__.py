"""Change-impact and governance analytics expressed as Spark DataFrame operators."""
