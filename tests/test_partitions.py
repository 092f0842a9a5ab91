"""Numbers of shuffle partitions."""

from panelforge import session


def test_partitions_follow_the_input(spark):
    """A task's sort holds a bounded part of the input: the shuffles' first number of partitions grows with the rows and is never lowered."""
    before = spark.conf.get(session.FIRST_PARTITIONS_KEY, None)
    try:
        session.size_partitions(spark, 1)
        assert spark.conf.get(session.FIRST_PARTITIONS_KEY, None) == before
        session.size_partitions(spark, 50_000_000)
        assert int(spark.conf.get(session.FIRST_PARTITIONS_KEY)) == 500
        session.size_partitions(spark, 1_000_000)
        assert int(spark.conf.get(session.FIRST_PARTITIONS_KEY)) == 500
    finally:
        spark.conf.unset(session.FIRST_PARTITIONS_KEY) if before is None else spark.conf.set(session.FIRST_PARTITIONS_KEY, before)


def test_ranks_of_hot_groups_read_their_input_once(spark, hot):
    """Where groups are cut into blocks, what lies upstream of the ranks runs for the size check and once more."""
    from panelforge.operators.ordered import average_ranks

    seen = spark.sparkContext.accumulator(0)

    def mark(i):
        seen.add(1)
        return i % 2, float(i % 17), float(-i)

    rows = spark.createDataFrame(spark.sparkContext.parallelize(range(400), 4).map(mark), "k long, a double, b double")
    got = average_ranks(rows, ["a", "b"], ["k"]).orderBy("k", "b").collect()
    assert seen.value <= 3 * 400
    assert [r["_rank_b"] for r in got if r["k"] == 0] == [float(i) for i in range(1, 201)] and {r["_count_a"] for r in got} == {200}


def test_many_tickers_are_found_again(spark):
    """The plan that undoes a thousand binary columns has no case for each of them; a row without a mark has no ticker."""
    from panelforge.operators import panel as P

    names = [f"T{i}.NZ" for i in range(1000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*names[::100], "other", None])], "timestamp long, ticker string")
    undone = P.undo_one_hot(P.one_hot_tickers(rows, names))
    assert [r["ticker"] for r in undone.orderBy("timestamp").collect()] == [*names[::100], None, None]
    assert undone._jdf.queryExecution().analyzed().toString().count("CASE WHEN") <= 1


def test_more_tickers_than_columns_are_one_sparse_vector(spark):
    """Twelve thousand tickers are no error and no twelve thousand columns: each row's mark is one element of a vector, in the order of the names, and is undone."""
    from panelforge.operators import panel as P

    names = sorted(f"T{i}.NZ" for i in range(12_000))
    frames = [spark.createDataFrame([(i, t) for i, t in enumerate(part)], "timestamp long, ticker string") for part in (names[:7000], names[5000:])]
    assert P.known_tickers(*frames) == names
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*names[::1000], "other", None])], "timestamp long, ticker string")
    coded = P.one_hot_tickers(rows, names)
    assert coded.columns == ["timestamp", "ticker", "Ticker_"]
    marks = [r["Ticker_"] for r in coded.orderBy("timestamp").collect()]
    assert [(m.size, m.indices.tolist(), m.values.tolist()) for m in marks[:-1]] == [*[(12_000, [1000 * i], [1.0]) for i in range(12)], (12_000, [], [])] and marks[-1] is None
    undone = P.undo_one_hot(coded.filter("timestamp >= 0"))
    assert undone.columns == ["timestamp", "ticker"] and [r["ticker"] for r in undone.orderBy("timestamp").collect()] == [*names[::1000], None, None]
