"""fernlode: corpus, code-graph and evidence analytics as lazy Spark DataFrame operators."""
