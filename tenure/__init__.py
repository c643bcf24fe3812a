"""Subscription retention analytics on Spark DataFrames.

``functions``  column expressions (dates, values, hashing)
``sources``    table schemas, file formats, staging, keyed upserts
``operators``  reusable DataFrame -> DataFrame steps (reshape, tally, ranking)
``plans``      the labelled cohort, its feature sets and the assembled datasets
``models``     Spark ML fitting, scoring and validation
"""
