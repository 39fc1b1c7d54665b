"""Plans: spatial joins are equi-joins, scans read what they need."""

from conftest import DATA

from stereoloom.operators import fusion, spatial
from stereoloom.plans import adapters as ad


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spatial_joins_have_no_product(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = ad.points(spark, DATA)
        for df in (spatial.radius_join(p, p, 0.1), spatial.supplement(p.filter("measured"), p, 0.1), spatial.far_excluded(p, 0.1), spatial.neighbour_frames(ad.frames(spark, DATA))):
            text = plan(df)
            assert "CartesianProduct" not in text and "NestedLoop" not in text
            assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fusion_aggregates_before_the_shuffle_and_reads_two_columns(spark):
    text = plan(fusion.fuse(ad.points(spark, DATA).drop("measured"), 0.1))
    assert "partial_sum" in text and "Python" not in text
    assert "ReadSchema: struct<embedding:array<float>,label:int>" in text and text.count("Exchange") == 1


def test_filters_reach_the_scan(spark):
    assert "LessThan(event_id,100)]" in plan(ad.frames(spark, DATA).filter("id < 100"))
    assert "LessThan(vec_id,100)]" in plan(ad.points(spark, DATA).filter("ordinal < 100"))
