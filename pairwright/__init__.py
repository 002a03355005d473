"""Preference data on Spark: chat logs and corpora in, pairs, folds, prompts, batches and labels out.

Every operator takes DataFrames and returns a DataFrame (or columns), so a
whole run is one logical plan that Catalyst can prune and AQE can re-plan.
"""
