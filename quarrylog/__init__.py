"""quarrylog: a logic-query engine and data-processing toolkit on Apache Spark."""
