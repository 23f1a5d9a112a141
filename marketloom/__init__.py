"""marketloom: market-offer analytics expressed as PySpark DataFrame jobs."""
