"""Training-data pipeline operators.

Nothing outside this folder imports it; ``queries`` holds the registered
queries, one module per operator holds the operator itself.
"""
