"""Course-shop data mart on Spark: every page, export and write path as a DataFrame job."""

from .schema import TABLES, table
from .shop import Shop
from .store import Store

__all__ = ["TABLES", "Shop", "Store", "table"]
