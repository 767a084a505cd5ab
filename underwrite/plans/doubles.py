"""Floating-point columns of each counterpart, rounded before comparison (see tools_doubles.py)."""

DOUBLE_COLUMNS: dict[str, str] = {
    "a12_request_payload": "loan_amnt annual_inc dti",
    "b02_number_from_text": "int_rate term revol_util loan_amnt",
    "b04_three_state_label": "label",
    "b05_right_censoring": "target_default",
    "b06_employment_years": "years",
    "b07_score_midpoint": "fico_score",
    "b10_canonical_projection": "loan_amnt term_months int_rate installment emp_length_years annual_inc dti delinq_2yrs fico_score inq_last_6mths open_acc pub_rec revol_bal revol_util total_acc mort_acc pub_rec_bankruptcies credit_history_months target_default",
    "b11_range_filter": "dti int_rate",
    "b12_derived_ratios": "loan_to_income installment_to_income revol_bal_to_income open_acc_ratio log_annual_inc",
    "b13_annuity": "payment",
    "b18_non_finite_to_null": "v",
    "b20_points": "points back",
    "b21_row_log_loss": "loss",
    "b23_numeric_coercion": "a b c",
    "c01_delayed_labels": "probability",
    "c02_fitted_value_lookup": "l_quantity woe",
    "c03_profile_matched_on_feature": "psi",
    "c05_newest_profile": "share null_rate mean roc_auc default_rate_observed",
    "c06_row_threshold_grid": "threshold",
    "d01_loans_per_year": "default_rate",
    "d02_expectations": "observed threshold",
    "d04_quality_log": "observed threshold",
    "d06_category_shares": "share",
    "d07_exact_medians": "median",
    "d08_missing_indicators": "null_share",
    "d09_numeric_profile": "share mean null_rate",
    "d09_profile_sample": "total",
    "d10_categorical_profile": "share",
    "d11_stability_index": "psi",
    "d12_two_sample_ks": "ks_statistic",
    "d13_ks_p_value": "ks_pvalue",
    "d14_feature_drift": "psi ks_statistic ks_pvalue null_rate_ref null_rate_cur mean_ref mean_cur",
    "d15_candidate_edges": "edge",
    "d16_merged_bins": "edge",
    "d18_weight_of_evidence": "share bad_rate woe iv_contribution",
    "d19_information_value": "iv",
    "d22_points_of_coefficient": "points",
    "d24_auc_gini": "roc_auc gini",
    "d25_average_precision": "pr_auc",
    "d26_ks_separation": "ks",
    "d27_brier_log_loss": "brier log_loss",
    "d28_calibration_error": "ece",
    "d29_confusion_rates": "precision recall f1 default_rate_observed default_rate_predicted",
    "d30_fit_diagnosis": "train_auc test_auc auc_gap",
    "d31_optimal_threshold": "threshold cost",
    "d32_threshold_curve": "threshold approval_rate bad_rate_approved recall precision expected_cost",
    "d33_curve_points": "threshold fpr tpr precision",
    "d33_roc_corners": "threshold fpr tpr",
    "d33_roc_corners_of_ties": "threshold fpr tpr",
    "d34_auc_interval": "auc se ci_low ci_high",
    "d35_paired_delong": "auc_a auc_b delta se z p_value ci_low ci_high",
    "d36_auc_table": "auc se ci_low ci_high",
    "d37_pairwise_comparison": "auc_a auc_b delta se z p_value ci_low ci_high p_holm",
    "d39_bootstrap_interval": "estimate ci_low ci_high",
    "d40_bootstrap_difference": "auc_diff ci_low ci_high p_value",
    "d41_two_proportions": "z p_value",
    "d42_wilson": "low high",
    "d43_discrimination_block": "auc auc_ci_low auc_ci_high gini ks pr_auc prevalence ks_ci_low ks_ci_high pr_auc_ci_low pr_auc_ci_high",
    "d44_spiegelhalter": "spiegelhalter_z spiegelhalter_p",
    "d45_calibration_line": "slope intercept",
    "d46_reliability_table": "mean_pd observed ci_low ci_high",
    "d47_brier_reference": "brier brier_reference mean_pd observed_rate",
    "d48_gains_table": "default_rate ci_low ci_high mean_pd cum_capture cum_population lift",
    "d49_vintage_stability": "auc ci_low ci_high ks observed mean_pd",
    "d50_spearman": "spearman",
    "d51_split_summary": "default_rate",
    "d53_global_importance": "mean_abs",
    "d54_pair_orientation": "delta ci_low ci_high p_holm",
    "d55_nearest_threshold": "threshold approval_rate bad_rate_approved recall precision expected_cost",
    "d56_gini_kept": "full_auc without kept",
    "d57_calibration_verdict": "intercept",
    "d58_vintage_summary": "auc_min auc_max last_mean_pd last_observed",
    "d59_dependence_points": "total contribution",
    "d60_kpi_row": "roc_auc prediction_psi default_rate_observed default_rate_predicted",
    "m01_preprocessor_fit": "number",
    "m02_preprocessor_transform": "numeric_sum flags purpose_building purpose_other",
    "m03_out_of_time_split": "target_default",
    "m09_eligible_candidates": "val_roc_auc val_auc_gap latency_ms",
    "m10_best_candidate": "val_roc_auc",
    "m11_parsimonious_selection": "auc delta_vs_best p_holm",
    "m12_test_report": "auc_a auc_b delta ci_low ci_high p_value p_holm",
    "m17_scoring_frame": "probability threshold",
    "m18_linear_contributions": "l_quantity l_discount l_tax",
    "o02_top_factors": "impact",
    "o03_strongest_variables": "mean_abs",
    "o07_benchmark_order": "val_roc_auc",
    "p04_sticky_assignment": "bucket",
    "p05_monthly_replay": "probability fico_score",
    "p08_concept_report": "auc_drop ks_drop brier_increase calibration_gap page_hinkley_statistic prior_shift_z",
    "p10_monitoring_drift": "psi ks_statistic ks_pvalue null_rate_ref null_rate_cur mean_ref mean_cur",
    "p10_monitoring_run": "prediction_psi roc_auc ks brier auc_drop default_rate_observed default_rate_predicted page_hinkley_statistic",
    "p11_arm_aggregates": "approval_rate bad_rate_approved",
    "p12_experiment_verdict": "approval_rate_champion approval_rate_challenger bad_rate_approved_champion bad_rate_approved_challenger auc_champion auc_challenger auc_diff ci_low ci_high p_value bad_rate_z bad_rate_pvalue months_running",
    "p13_comparable_population": "total",
    "p15_variant_fallback": "probability",
    "t01_tumbling_windows": "mean_value error_rate",
    "t02_sliding_windows": "mean_value",
    "t04_hot_key": "statistic",
    "t04_stateful_detectors": "statistic",
    "t06_micro_batch_log": "probability",
    "u01_variant_union": "probability",
    "u02_evidence_union": "auc auc_ci_low auc_ci_high",
    "u03_distinct_values": "l_quantity l_discount",
    "w01_average_rank": "p_a avg_rank",
    "w02_cumulative_counts": "score",
    "w04_holm": "p p_holm",
    "w05_ddm": "min_p_plus_s",
    "w05_ddm_per_key": "min_p_plus_s",
    "w06_page_hinkley": "statistic",
    "w06_page_hinkley_per_key": "statistic",
    "w07_one_row_per_id": "l_quantity",
    "w08_neighbour_midpoints": "l_quantity edge",
    "x01_parse_as_expressions": "loan_to_income",
    "x02_ranking_of_single_variable": "auc se",
    "x04_custom_bootstrap_metric": "estimate ci_low ci_high",
}
