"""Operations of a training-data pipeline over documents and pages.

Each module holds one operator with a general interface; ``queries`` applies them to whole
tables. Nothing else in the library imports this package.
"""
