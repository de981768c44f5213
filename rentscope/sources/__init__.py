"""Sources (driver tables, original schema, JDBC) and sinks."""

from rentscope.sources import domain, driver, layout, sinks

__all__ = ["domain", "driver", "layout", "sinks"]
