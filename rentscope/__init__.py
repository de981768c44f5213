"""rentscope: customer / rental / payment analytics as Spark DataFrame jobs."""

from rentscope.model import RentalData

__all__ = ["RentalData"]
__version__ = "0.1.0"
