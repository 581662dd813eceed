"""Object queries over regions of nested rows, translated to Spark SQL."""

from tessera.oql.engine import Region, Regions
from tessera.oql.parser import OqlError, parse

__all__ = ["OqlError", "Region", "Regions", "parse"]
