"""tarmac: road-network analytics and live traffic on PySpark."""
