"""Training-data operators (sub-package). Nothing else in the library imports it."""
