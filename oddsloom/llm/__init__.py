"""Operations of a training-data pipeline: encode, shard, mix, search, scan, format, store, classify.

Nothing outside this subpackage imports it.
"""
