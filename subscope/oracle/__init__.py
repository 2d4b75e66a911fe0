"""DuckDB SQL used as the correctness oracle for the SQL-expressible queries."""
