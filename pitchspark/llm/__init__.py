"""Training-data operators: quality, deduplication, decontamination, packing, scanning and formatting.

Nothing else in ``pitchspark`` imports this subpackage.
"""
