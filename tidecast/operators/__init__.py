"""Operators: functions from DataFrames to DataFrames.

Fitted state is a small dict or a DataFrame returned by ``fit_*`` and passed to ``apply_*``.
Window operators expect one row per (keys, calendar period): ``aggregate.rollup`` makes that
grain with partial aggregation, so no window group is longer than the calendar, however many
source rows one key has.
"""
