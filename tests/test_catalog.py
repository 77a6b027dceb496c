"""Every SQL twin names a query, and the flagship query runs."""

import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "event_type", "value"] and df.count() > 0


#: Queries without an SQL twin, and the property query (with a twin) or the test that holds their results.
HELD = {
    "syn_copula": "syn_copula_fit", "syn_copula_quality": "syn_copula_fit", "syn_privbayes": "syn_privbayes_fit", "syn_tree": "syn_tree_fit", "syn_sequence": "syn_sequence_fit",
    "syn_from_recipe": "syn_pipeline", "rem_bin_kmeans": "rem_bin_kmeans_small", "out_iforest": "out_iforest_fit", "out_iforest_stats": "out_iforest_fit", "out_lof_stats": "out_lof_fit",
    "drift_classifier": "drift_classifier_shift", "sug_importance": "sug_importance_fit", "sug_utility_lognormal": "sug_utility", "tf_tfidf": "tf_tfidf_terms",
    "dist_fit": "tests/test_profiles.py", "ev_mmd": "tests/test_synthesis.py", "ev_all": "tests/test_synthesis.py", "ev_compare": "ev_compare_valid",
    "op2_": "tests/llm/test_models.py", "op3_": "tests/llm/test_models.py", "op4_": "tests/llm/test_pages.py", "op5_": "tests/llm/test_models.py", "op6_": "tests/llm/test_licenses.py",
    "op7_": "tests/llm/test_joins.py", "op9_": "tests/llm/test_joins.py", "op10_": "tests/llm/test_encoding.py", "pipeline": "tests/llm/test_pipeline.py",
}


def test_every_query_has_a_twin_a_property_or_a_test():
    import os

    q, o = entry.queries(), entry.oracle_sql()
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in sorted(set(q) - set(o)):
        holder = next((h for k, h in HELD.items() if name == k or k.endswith("_") and name.startswith(k)), None)
        assert holder is not None, name
        assert holder in o or os.path.exists(os.path.join(top, holder)), (name, holder)
