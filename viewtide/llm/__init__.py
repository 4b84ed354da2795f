"""Training-data operators: near-duplicates, quality, mixing, decontamination, secrets,
repetition rules, token rollups, language identification, URL filters, HTML extraction.

Each module holds one operator with its own general interface. ``queries`` derives the
registered queries from them; nothing outside this package imports it.
"""
