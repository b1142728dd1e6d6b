"""Order-flow analytics and corpus preparation as Spark DataFrame operators."""
