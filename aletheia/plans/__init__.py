"""Model plans: which rows train and test which model.

Every evaluation mode is the same job with a different pair of small tables
``train_plan(model_id, source, part)`` and ``test_plan(model_id, source,
part)`` (part NULL = all rows of that source).  Plans depend only on the
distinct source names (S of them: at most S² rows), never on row counts.
"""

from aletheia.plans.plans import (  # noqa: F401
    PLAN_SCHEMA,
    all_vs_each_plans,
    incremental_order_table,
    incremental_orders,
    incremental_plans,
    leave_one_out_plans,
    leave_one_out_table,
    matrix_test_plan,
    param_grid,
    separate_plans,
)
