"""vitaeloom: set-oriented PySpark operators that align candidate documents with job postings."""
