"""Column-level analytics on Spark for credit-portfolio and campaign data."""
__version__ = "0.1.0"
