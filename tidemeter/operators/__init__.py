"""DataFrame -> DataFrame operators over records, the hour cube and entity tables."""
