"""Query and ingest operators: DataFrame in, DataFrame out."""
