"""Relational operators, one function each; all take and return lazy DataFrames."""

from lumbre.operators.aggregate import Metric, approximate_distinct, cube, decode_states, distinct_counts, encode_states, final_state, grouped, grouped_spill, grouping_sets, merge_states, partial_state, pivot, rollup, summary
from lumbre.operators.clean import drop_duplicates, drop_nulls, fill_null, impute_mean, keep_first
from lumbre.operators.combine import as_of_join, band_join, cross_join, except_all, except_distinct, intersect_all, intersect_distinct, join, join_size, theta_join, union_all, union_distinct
from lumbre.operators.order import head, merge_sorted, sort, top_k
from lumbre.operators.project import add_categorical, add_column, add_month, add_product, column_metadata, filter_mask, filter_number, filter_positive_product, filter_text, parse_condition, select, set_metadata, unpivot, validate
from lumbre.operators.quantile import exact_percentiles
from lumbre.operators.windows import cumulative, lagged, ranked, sessions, sliding, tumbling

__all__ = [n for n in dir() if not n.startswith("_")]
