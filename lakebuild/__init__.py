"""lakebuild: layered lake tables from fixed-width and delimited feeds, on Spark."""

from .layouts import LAYOUT_CMP, LAYOUT_FIN, LAYOUT_SEC, FieldSpec
from .paths import LakePaths
from .session import get_spark

__all__ = ["FieldSpec", "LAYOUT_CMP", "LAYOUT_FIN", "LAYOUT_SEC", "LakePaths", "get_spark"]
