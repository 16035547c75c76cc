"""DataFrame operators.  Each is ``f(df, ...) -> DataFrame``."""
