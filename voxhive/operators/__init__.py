"""DataFrame -> DataFrame operators of the mapping system."""
