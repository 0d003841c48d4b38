"""Business-table and usage-log analytics on Spark DataFrames."""

from .operators.clean import (
    clean, cleaning_log, fill_median, fill_mode, find_duplicates, mark_duplicates, mark_outliers, quality_score,
    unparsed_dates,
)
from .operators.customers import rfm_overview, rfm_scores, rfm_segments, rfm_summary, rfm_values
from .operators.insights import insights
from .operators.profile import (
    desc_overview, desc_stats, profile_columns, profile_dates, profile_numeric, profile_text, sample_rows,
    sample_values,
)
from .operators.ranking import (
    concentration, drill_down, drill_down_cube, drill_down_top, item_totals, pareto_abc, pareto_summary, region_analysis,
    region_extremes, top_ranking,
)
from .operators.roles import assign_roles, infer_roles, role_ambiguity
from .operators.series import (
    annual_summary, coerce_date, date_range_filter, drop_null_keys, forecast_fitted, inflection_points, mom_growth,
    monthly_series, moving_avg_3, simple_forecast, time_series, yoy_comparison, yoy_summary,
)
from .operators.stats import (
    anderson_darling, anomaly_detect, anomaly_summary, corr_p_values, corr_pearson, corr_spearman, distribution, normality_test,
    redundant_pairs, strong_pairs,
)
from .operators.stored_profile import stored_parts, stored_profile, update_profile
from .operators.usage import (
    budget_alert, depth_violations, member_usage, quota_violations, rate_refusals, rate_violations, usage_calls_per_day, usage_cost,
    usage_daily, usage_daily_by, usage_monthly, usage_top_expensive, usage_user_breakdown, usage_user_stats,
)
from .plans.report import Report, monthly_facts, quick_summary, region_facts, report_suite, slim
from .sources.charsets import fit_charsets
from .sources.delimited import normalize_columns, read_delimited, read_inline, validate_input
from .sources.heads import file_heads
from .sources.intake import detect_delimiter, detect_delimiter_text, detect_encoding, file_magic_audit
from .sources.usage_log import USAGE_SCHEMA, append_usage_log, parse_usage_lines, read_usage_log
from .streaming.usage_stream import stream_rate_limit, stream_usage_daily, stream_usage_log
