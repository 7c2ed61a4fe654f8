"""Attempts of a search tool, and settings of the fact weight, by hand."""

from pyspark.sql import functions as F

from docloom.operators import agent, tuning


def test_first_grounded_attempt_wins(spark):
    chunks = [(i, f"src{i}", "guide" if i < 4 else "casebook", 0, f"s{i}", "alpha beta text" if i in (1, 5, 6) else "alpha only here") for i in range(8)]
    chunks = spark.createDataFrame(chunks, "id long, source_path string, doc_role string, is_normalized int, section string, text string")
    semantic = {0: 0.1, 1: 0.2, 5: 0.5, 6: 0.4}
    scored = [(q, i, r + 1, 1.0 - r / 10, semantic.get(i, 0.05), 100) for q in (1, 2, 3) for r, i in enumerate([5, 1, 6, 0, 4, 2, 3, 7])]
    scored = spark.createDataFrame(scored, "query_id long, id long, rank int, score double, semantic double, uploaded_at long")
    plans = spark.createDataFrame([(1, "alpha beta", ["guide", "casebook", "all"]), (2, "alpha beta", ["guide"]), (3, "gamma", ["all", "guide"]), (4, "no rows", ["all"])], "query_id long, query string, plan array<string>")
    got = {r.question: r for r in agent.search(plans, scored, chunks).collect()}
    assert (got[1].role, got[1].passed, got[1].tried, got[1].ids) == ("casebook", True, 2, [5, 6, 4, 7])
    assert (got[2].role, got[2].passed, got[2].tried, got[2].ids) == ("guide", False, 1, [1, 0, 2, 3])
    assert set(got) == {1, 2}  # no critical term is found, or nothing at all


def test_settings(spark):
    tried = tuning.settings(spark, (0.1, 0.5), (0.55, 0.8))
    base = spark.createDataFrame([(1, 10, 0.5, 0.0, True, 5), (1, 11, 0.26 * 0.9 + 0.2, 0.9, True, 5), (1, 12, 0.26 * 0.9, 0.9, False, 5)], "query_id long, id long, score double, ontology double, own boolean, uploaded_at long")
    facts = spark.createDataFrame([(1, 11, 1, 0.9, 0.6, "active"), (1, 12, 2, 0.9, 0.9, "active")], "query_id long, id long, fact_id long, score double, confidence double, status string")
    ranks = {(r.no, r.id): r["rank"] for r in tuning.ranks(base, facts, tried, 0.26).collect()}
    assert ranks == {(0, 10): 1, (0, 11): 2, (0, 12): 3, (1, 10): 1, (1, 11): 2, (1, 12): 3, (2, 11): 1, (2, 10): 2, (2, 12): 3, (3, 10): 1, (3, 12): 2, (3, 11): 3}
    expected = spark.createDataFrame([(1, [11]), (2, [])], "query_id long, expected array<bigint>")
    out = {r.no: r for r in tuning.compare(tuning.ranks(base, facts, tried, 0.26), expected, tried).collect()}
    assert [out[i].mrr for i in range(4)] == [0.5, 0.5, 1.0, round(1 / 3, 6)] and [i for i in out if out[i].best] == [2]
    assert tuning.compare(tuning.ranks(base.limit(0), facts, tried, 0.26), expected.filter(F.lit(False)), tried).count() == 4
