"""docloom: a document-intelligence engine expressed as PySpark DataFrame plans."""
