"""Every operator as a named query over the given tables, with the SQL that checks it."""
