"""DataFrame -> DataFrame operators, usable with ``DataFrame.transform``."""
