"""Training-data operators: decontamination, token files, scoring, filtering, de-duplication, packing and sharding.

Each module holds one operator with its own general interface; ``queries`` wraps them with
production parameters for the driver.
"""
