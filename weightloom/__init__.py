"""Portfolio-policy analytics expressed as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``);
nothing is executed until the caller runs an action.
"""
