"""Builders of Spark SQL expressions.

Each function takes SQL expressions (usually column names) and returns a SQL
expression.  They are used through ``F.expr`` / ``selectExpr`` and are also
registered as SQL functions, so there is one definition for both surfaces and
everything stays inside the JVM.
"""
