"""catchwise: watershed and streamflow analytics as Spark DataFrame programs.

Every operator is a function ``DataFrame -> DataFrame``.  Geometry lives in
vertex, edge, segment and cell tables, so joins, windows and aggregations do
the work and Catalyst chooses the physical plan.
"""

__version__ = "0.1.0"
