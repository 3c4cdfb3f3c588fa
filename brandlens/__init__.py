"""Brand-visibility analytics as Spark plans."""
