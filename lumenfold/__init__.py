"""Evidence analytics over text and artifacts, expressed as Spark DataFrame plans."""
