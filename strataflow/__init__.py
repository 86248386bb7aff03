"""strataflow: hybrid retrieval analytics and corpus preparation as Spark DataFrame plans."""
