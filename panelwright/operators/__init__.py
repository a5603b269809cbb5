"""DataFrame -> DataFrame operators over (Code, Date) panels."""
