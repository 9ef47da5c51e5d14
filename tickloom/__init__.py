"""tickloom: market-microstructure tables, windows and streams on PySpark."""
