"""Column functions: everything here builds expressions, none touches rows."""
