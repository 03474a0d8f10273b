"""riskspark: code-risk analytics as PySpark DataFrame operators."""
