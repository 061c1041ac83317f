"""Training-data operators (ten methods and the pipeline built from them).

Nothing else in the library imports this subpackage.
"""
