"""Training-data operators: ten self-contained modules plus the queries that apply them.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame and column names, returns a
DataFrame, and reads only the columns it names, so extra columns (whatever they are called) never clash.
"""
