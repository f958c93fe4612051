from leadflow.functions.columns import (  # noqa: F401
    coerce_date, extract_date, to_number, safe_divide, rate, revenue_per,
    month_of, weekday_of, uri_tail, key_hash, key_id, is_expired, is_valid,
    run_timestamp_from_name, truthy_or, in_date_range,
)
from leadflow.functions.metrics import RATIOS, Ratio, ratio_columns, with_ratio  # noqa: F401
