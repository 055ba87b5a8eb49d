"""Operations for training-data pipelines: deduplication, decontamination, mixing, tokens, chat text.

Nothing else in the library imports this subpackage. Each module holds one operator; ``registry``
holds the queries and their SQL.
"""
