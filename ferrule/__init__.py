"""ferrule: retrieval, text analytics and corpus preparation as plain PySpark DataFrame operators."""
