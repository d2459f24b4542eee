from .tables import TABLES, table  # noqa: F401
