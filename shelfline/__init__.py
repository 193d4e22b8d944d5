"""shelfline: product-availability analytics and corpus preparation on PySpark."""
