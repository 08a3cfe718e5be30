"""Training-data operators: search, mixing, sharding, filtering, packing, de-duplication, archives.

Nothing else in the library imports this subpackage.
"""
