"""XML analytics over DataFrames: one scan turns documents into relations, everything after it is Spark algebra."""
