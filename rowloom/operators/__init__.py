"""Relational operators on coordinate tables: products, ordinal walks, relation joins, labels."""
