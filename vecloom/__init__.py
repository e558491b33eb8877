"""Vector search, document analytics and training-data operators as Spark plans."""
