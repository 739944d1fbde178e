"""Evidence-based record matching, ranking and auditing as Spark DataFrame expressions."""
