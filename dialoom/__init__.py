"""dialoom - labelled conversation datasets on Spark.

Every operator is a plain function ``DataFrame -> DataFrame``: nothing is collected inside an
operator, and nothing is assumed about how many rows, turns or words one conversation holds.
"""
