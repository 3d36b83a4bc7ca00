"""shelfspan: inventory-depletion survival analytics as Spark DataFrame jobs."""
