import pytest

import __spark_entry__ as entry
from check_queries import connect, differences, frame, type_differences

# The quick ones; check_queries.py runs all of them at any scale.
QUICK = (
    "conform_documents", "row_ids_stable", "normalize_text", "fold_accents", "cue_vector",
    "page_registered_domain", "normalize_dedup", "content_checksum", "confusion",
    "selective_metrics", "stratified_report", "cache_keys", "parse_responses", "template_rows",
    "built_cues", "nfkc_forms", "registered_domain_kinds", "union_dedup_partitioned",
)


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert own - set(entry.oracle_sql()) == {
        "fit_text_classifier", "fit_without_cues", "explain_model", "experiment"
    }


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, data, name):
    out = entry.queries()[name](spark, data)
    result = connect(data).sql(entry.oracle_sql()[name])
    assert type_differences(out, result) is None
    theirs = frame(result.columns, result.fetchall())
    assert differences(frame(out.columns, [tuple(r) for r in out.collect()]), theirs) is None
    assert len(theirs)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows[0]["subgroup"] == "overall" and rows[0]["n"] == 87


def test_sources_of_prepare_are_written_in_order_by_many_tasks(spark, data, monkeypatch):
    written = {}

    def keep(rows, folder, name):
        written[name] = rows.rdd.glom().map(len).collect(), [r.id for r in rows.select("id").collect()]

    monkeypatch.setattr(entry.files, "write_source", keep)
    monkeypatch.setattr(entry, "prepare", lambda *args, **kw: None)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        entry.prepare_corpus(spark, data)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    for sizes, ids in written.values():
        assert len(sizes) > 1 and max(sizes) < sum(sizes)
        keys = [tuple(map(int, i.split("_")[1:])) for i in ids]
        assert keys == sorted(keys)
