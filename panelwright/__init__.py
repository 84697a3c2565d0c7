"""Event analytics on daily panels, written as PySpark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function built from Spark's
own columns, windows and joins; the numeric rules live in :mod:`panelwright.config`.
"""

__version__ = "0.1.0"
