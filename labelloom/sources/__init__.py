"""Reading and writing tables of labelled text."""
