"""The canonical views open tables without touching what the session calls by the same names."""

from quarrygraph.plans.views import view


def test_views_leave_the_sessions_own(spark, sf_dir):
    spark.range(3).createOrReplaceTempView("documents")
    try:
        assert view(spark, sf_dir, "spans").count() > 3
        assert spark.table("documents").count() == 3
    finally:
        spark.catalog.dropTempView("documents")
