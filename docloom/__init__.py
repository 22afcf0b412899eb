"""docloom: document-structure analytics expressed as Spark DataFrame plans."""
