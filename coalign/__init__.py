"""coalign: record linkage and data quality on PySpark."""
