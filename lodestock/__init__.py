"""Content-addressed dataset catalog on Spark DataFrames."""

from lodestock.catalog import Catalog, ImportOutcome
from lodestock.table_catalog import TableCatalog

__all__ = ["Catalog", "ImportOutcome", "TableCatalog"]
__version__ = "0.2.0"
