"""Column builders: text.py and sequences.py compose built-in functions; python.py holds the few that need Arrow UDFs."""
