"""Column functions: Column -> Column, no Python UDFs."""
