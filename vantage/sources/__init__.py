"""Landing files and tables to normalised rows."""
