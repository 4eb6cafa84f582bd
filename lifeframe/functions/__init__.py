"""Column functions: everything here maps Columns to Columns and stays inside code generation."""
