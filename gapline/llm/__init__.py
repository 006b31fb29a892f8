"""Training-data operators: mixing, sharding, cleaning, de-duplication and output.

Every operator takes a DataFrame and column names, reads only those columns
(so other columns, whatever their names, neither matter nor clash) and returns
columns named in its docstring.  ``queries`` holds the thin ``opN_*`` queries.
"""
