"""Column functions, for use in any plan: each takes and gives columns, and stays in generated code."""

from vitalframe.operators.records import fold, number, state_of
from vitalframe.operators.rules import alert_key, confidence, iso_week
from vitalframe.operators.series import egfr
from vitalframe.operators.text import age_at, days_of, dose_of, kilograms, metres, said_day, said_range
from vitalframe.operators.units import fold_unit, read_number
from vitalframe.sources.readers import partial_date
from vitalframe.streaming.incremental import dedup_key

__all__ = ["age_at", "alert_key", "confidence", "days_of", "dedup_key", "dose_of", "egfr", "fold", "fold_unit", "iso_week", "kilograms", "metres", "number", "partial_date", "read_number", "said_day", "said_range", "state_of"]
