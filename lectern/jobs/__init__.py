"""Jobs: the library's queries over the driver tables."""
