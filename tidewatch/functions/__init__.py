"""Column expressions: decimals, knowledge states, time, text rules, hashing, progress."""
