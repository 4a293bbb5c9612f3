"""Point-in-time market analytics and corpus preparation as Spark DataFrame operators."""
