"""Binary-outcome experiments on Spark tables.

The package is split by what a piece does:

``sources``    reading, pulling and replacing catalog tables
``functions``  column expressions (null policy, flags, keep-lists, key hashes)
``operators``  DataFrame -> DataFrame steps: keys, profiling, splits, encoding,
               models, search and exact evaluation
``plans``      whole experiments: roles, runs, the run log, ready-made grids
``streaming``  scoring a stream with a model fitted in batch
"""
