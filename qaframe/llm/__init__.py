"""Training-data operators: quality rules, tokenising, packing, near-duplicate
search, sharding, archives.  Nothing else in the library imports this
subpackage."""
