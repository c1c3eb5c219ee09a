"""paywatch: payment-risk analytics as PySpark DataFrame operators."""
