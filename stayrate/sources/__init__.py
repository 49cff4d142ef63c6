"""Reading and writing tables, files and fitted objects."""
