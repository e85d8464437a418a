"""Analytics for software supply-chain security data, and training-data preparation, on PySpark."""
