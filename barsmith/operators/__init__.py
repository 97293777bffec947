"""Operators: functions ``f(df, ...) -> DataFrame``; none of them runs an action."""
