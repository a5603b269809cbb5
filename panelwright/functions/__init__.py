"""Column expressions: keys, safe arithmetic, bar shapes."""
