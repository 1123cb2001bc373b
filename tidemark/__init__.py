"""Episode quality audits as Spark DataFrame plans."""
