"""Training-data operators: ten DataFrame operators for preparing text corpora.

Nothing outside this package imports it; deleting the folder leaves the rest of
the library working.
"""
