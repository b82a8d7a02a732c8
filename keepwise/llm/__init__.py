"""Training-data pipeline operators (one module each). Nothing else in the
library imports this package; ``queries.py`` registers one query per operator."""
