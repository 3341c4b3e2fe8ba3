from .readers import read_feed, read_jdbc, read_shop, read_table

__all__ = ["read_feed", "read_jdbc", "read_shop", "read_table"]
