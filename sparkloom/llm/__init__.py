"""Training-data operators: quality, tokens, language, duplicates, leaks and chat rendering.

Nothing outside this package imports it; ``sparkloom.llm.registry`` lists its queries.
"""
