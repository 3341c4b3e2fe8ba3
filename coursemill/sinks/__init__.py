from .csv_files import write_csv, write_exports

__all__ = ["write_csv", "write_exports"]
