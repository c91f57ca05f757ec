from sparkcorpus.queries.quality import sign_test


def test_a_mean_between_two_scores_does_not_depend_on_order(spark):
    """The same values in another order are a tie, though 0.7 + 0.2 + 0.1 is below 1 and 0.1 + 0.2 + 0.7 is not."""
    arms = [0.7, 0.2, 0.1] + [0.0] * 17, [0.1, 0.2, 0.7] + [0.0] * 17
    rows = [(2 * i + k, 1, v) for k, arm in enumerate(arms) for i, v in enumerate(arm)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1)
    got = sign_test(lambda name: events).first()
    assert (got["win"], got["lose"], got["tie"]) == (0, 0, 1)
