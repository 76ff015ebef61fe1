"""Documents from files and tables."""
