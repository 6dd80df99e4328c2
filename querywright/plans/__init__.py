"""SQL trees: parser, printer for Spark SQL, and the catalogue of queries."""
