"""Table operators: functions from DataFrame to DataFrame, and fitted parameters with ``apply``."""
