"""Training-data operators: ten DataFrame-in, DataFrame-out building blocks.

Nothing else in the library imports this subpackage.
"""
