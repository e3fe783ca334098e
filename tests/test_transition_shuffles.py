"""Transitions: pairs are dealt out once, and only what is asked for is compared."""

from collections import Counter

from encore.operators import transitions


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def expected(rows, max_gap):
    lists = {}
    for pid, pos, track in rows:
        lists.setdefault(pid, {})[pos] = track
    pairs = Counter()
    for places in lists.values():
        for pos, track in places.items():
            for gap in range(1, max_gap + 1):
                if pos + gap in places and track is not None:
                    pairs[track, places[pos + gap]] += 1
    totals = Counter()
    for (prev, _), n in pairs.items():
        totals[prev] += n
    return {(prev, nxt): (n, totals[prev], n / totals[prev]) for (prev, nxt), n in pairs.items()}


def found(df):
    rows = df.collect()
    out = {(r["prev"], r["next"]): (r["n"], r["total"], r["p"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_pairs_meet_their_totals_without_a_join(spark):
    """Null items follow others, but nothing follows a null item; list 3 has more than one segment."""
    rows = [(p, i, None if (p, i) == (1, 5) else f"t{(p * 37 + i * i) % 701}") for p in range(30) for i in range(1 if p == 2 else 2100 if p == 3 else 40)]
    tracks = spark.createDataFrame(rows, "pid long, pos long, track_uri string")
    fitted = transitions.fit_transitions(tracks, 3)
    assert "Join" not in optimized(fitted)
    assert found(fitted) == expected(rows, 3)


def test_heavy_items_are_totalled_across_tasks(spark, skewed):
    rows = [tuple(r) for r in skewed.select("pid", "pos", "track_uri").collect()]
    for max_gap in (1, 2):
        assert found(transitions.fit_transitions(skewed, max_gap)) == expected(rows, max_gap)


def test_only_transitions_of_last_seeds_are_compared(spark, monkeypatch):
    seen = []
    best_next = transitions.best_next
    monkeypatch.setattr(transitions, "best_next", lambda t: seen.extend(r["prev"] for r in t.collect()) or best_next(t))
    table = spark.createDataFrame(
        [("a", "b", 1, 3, 1 / 3), ("a", "c", 2, 3, 2 / 3), ("b", "a", 1, 1, 1.0), (None, "a", 1, 1, 1.0)],
        "prev string, next string, n long, total long, p double",
    )
    seeds = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "x"), (3, 0, None)], "pid long, pos long, track_uri string")
    rows = [tuple(r) for r in transitions.next_item(seeds, table).collect()]
    assert rows == [(1, "a", "c", 2 / 3)]
    assert set(seen) == {"a"}
