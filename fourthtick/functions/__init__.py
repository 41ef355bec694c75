"""Column expressions shared by the plans. All of them are built-in Spark functions."""
