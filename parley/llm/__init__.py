"""Training-data operators: language, decontamination, licences, near duplicates, quality, mixing, token files, HTML.

Nothing outside this subpackage imports it. ``queries.QUERIES`` and ``queries.ORACLES`` hold what the entry file registers.
"""
