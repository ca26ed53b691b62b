"""Training-data operators.  Each module holds one operator, its registered query and, where
SQL can express it, the oracle text.  Nothing outside this subpackage imports it."""
