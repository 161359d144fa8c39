"""Column helpers; all of them are compositions of built-in functions."""
