"""Tidewatch: time-aware market and news risk analytics as Spark DataFrame functions.

Two rules hold everywhere: a row counts at instant *t* only if it was received by *t*,
and a missing value is never treated as zero.
"""
