"""Document analytics on Spark: document-style queries compiled to DataFrame plans."""
