"""Training-data operators: secrets, toxicity, deduplication, language, HTML, licences, byte-level
BPE and mixing. One module per operator; ``queries`` registers them over the driver's tables.

Nothing else in ``strata`` imports this subpackage.
"""
