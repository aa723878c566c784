"""Scheduled visits and their attendance, as PySpark DataFrame operators.

Every operator takes whole tables and explicit parameters (the reference date
``as_of`` above all) and returns a lazy DataFrame that holds the answer for all
users, dates and visits at once; one user's answer is a filter on top.
"""
