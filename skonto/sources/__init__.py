"""Reading tables, bank statements and files; writing results."""
