"""Training-data pipeline operators over document tables.

Each module holds one operator with a general interface; ``queries`` applies
them to the ``documents`` table with production parameters.
"""
