"""Code-flow and trace analytics as Spark DataFrame operators."""
