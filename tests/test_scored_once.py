"""What a query needs of the scores several times is computed once."""

import pytest

from feedloom.plans import state_queries, testbed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["external_scorer", "external_outcomes", "score_history"])
def test_every_listing_is_scored_once(spark, monkeypatch, name):
    scored, seen = state_queries.scored, spark.sparkContext.accumulator(0)

    def counted(spark, sf_dir):
        rows = scored(spark, sf_dir)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(count, rows.schema)

    monkeypatch.setattr(state_queries, "scored", counted)
    assert state_queries.QUERIES[name][0](spark, SF).collect()
    assert seen.value == testbed.table(spark, SF, "documents").count()
