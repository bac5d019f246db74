"""a record's features are collected once, and its lists of genes and proteins are taken from them."""

from granary.plans import media


def test_a_feature_is_shuffled_once(spark, sf_dir):
    plan = media.QUERIES["h12_record_json"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 2  # the features, and the numbers by type
