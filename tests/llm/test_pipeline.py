import os

import pytest
from test_packing_topk_dedup import check_packing, classes_by_hand
from test_text_operators import judge_by_hand

import corpus_pipeline
from quillon.llm import classifier, quality_rules
from quillon.llm.queries import QUERIES, ORACLE_SQL, tokenizer_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}

    judged = judge_by_hand([(i, r["text"], r["source"]) for i, r in rows.items()], quality_rules.MIN_DOCS, quality_rules.HOST_SHARE, quality_rules.MIN_KEPT_SHARE)
    by_rules = {r[0] for r in judged if r[7]}
    (_, rules), (_, quality), (_, dedup), (_, packing) = corpus_pipeline.STAGES
    one = rules(spark, docs, SF)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == by_rules < set(rows)

    good = quality(spark, one, SF)
    scores = {r["doc_id"]: r["score"] for r in classifier.score(one, classifier.learn(one, labels)).collect()}
    by_score = {i for i, s in scores.items() if s >= classifier.THRESHOLD}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == by_score < by_rules

    left = [(i, rows[i]["text"]) for i in sorted(by_score)]
    few = dedup(spark, good, SF)
    classes = classes_by_hand(left)
    firsts = {i for i, c in classes if i == c}
    assert few.columns == docs.columns and {r["doc_id"] for r in few.collect()} == firsts < by_score

    path = tokenizer_path("word_bpe_49k.json")
    check_packing(packing(spark, few, SF).collect(), [(i, rows[i]["text"]) for i in sorted(firsts)], path)
    check_packing(corpus_pipeline.run(spark, SF).collect(), [(i, rows[i]["text"]) for i in sorted(firsts)], path)


def test_rules_stage_has_an_absolute_limit_on_a_large_host(spark):
    own = "array_join(transform(sequence(1, 12), k -> concat('w', id, 'x', k)), ' ')"
    common = "CASE WHEN id < 1005 THEN '\\nshared by many' WHEN id < 2005 THEN '\\nshared by fewer' ELSE '' END"  # 1,005 and 1,000 of 21,000 documents, both under 5 %
    docs = spark.range(21_000).selectExpr("id AS doc_id", f"{own} || {common} AS text", "'en' AS lang", "'h' AS source", "1L AS n_chars")
    left = corpus_pipeline.quality_rules_stage(spark, docs, SF)
    assert left.count() == 21_000 and left.where("contains(text, 'shared by many')").count() == 0
    assert left.where("contains(text, 'shared by fewer')").count() == 1000
    assert quality_rules.judge(docs).where("n_removed > 0").count() == 0  # the query's rule is that of its SQL


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_names_and_sql(spark):
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    pick = lambda columns, found: sorted([tuple(r[columns.index(c)] for c in sorted(names)) for r in found], key=repr)
    assert pick(got.columns, got.collect()) == pick(names, cursor.fetchall())


def test_native_operators_have_no_python_in_their_plans(spark):
    for name in ("op1_license_scans", "op7_url_filters", "op9_quality_rules", "op10_sharding"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
