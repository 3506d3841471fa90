"""lotwise: listing intelligence on PySpark.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from native
Column expressions; Python workers are used only where a document tree or a
numeric model has to be walked.
"""
