"""daymill: activity-log analytics on PySpark.

Every operator is a plain ``DataFrame -> DataFrame`` function (usable with
``DataFrame.transform``) or a ``Column -> Column`` function.
"""
