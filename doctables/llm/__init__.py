"""Operators for preparing training data for language models, with their queries.

Nothing else in the library imports this subpackage. Each module holds one operator and its
registered query; ``queries.py`` gathers them."""
