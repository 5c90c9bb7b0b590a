"""Training-data operators: thirteen corpus operators, each in its own module.

``queries.py`` registers one query per operator; nothing else in the library
imports this subpackage.
"""
