"""tracklens — movement analytics on Spark DataFrames.

Every result is a lazily planned DataFrame built from built-in Column
expressions; nothing is collected to the driver except one-row scalars
used as parameters (time origin, map centre).
"""

from tracklens.params import Period, ThinParams  # noqa: F401

__all__ = ["Period", "ThinParams"]
