"""matchloom: document-matching analytics as Spark DataFrame functions."""
