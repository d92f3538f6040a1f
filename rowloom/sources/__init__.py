"""Reading and checking the tables of a model."""
