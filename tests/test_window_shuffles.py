"""Windows: lists within one segment are dealt out once and not numbered by a join."""

from encore.operators import segments


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def expected(rows, length, dropped):
    lists = {}
    for pid, pos, item in rows:
        if pid is not None and pos is not None and item != dropped:
            lists.setdefault(pid, []).append((pos, item))
    out = set()
    for pid, cells in lists.items():
        items = [item for _, item in sorted(cells)]
        out |= {(pid, i, tuple(items[i : i + length]), tuple(items[i + 1 : i + length + 1])) for i in range(len(items) - length)}
    return out


def check(spark, rows, joins):
    encoded = spark.createDataFrame(rows, "pid long, pos long, item_id long")
    windows = segments.playlist_windows(encoded, 3, drop_item=0)
    assert ("Join" in optimized(windows)) == joins
    found = [(r["pid"], r["start"], tuple(r["x"]), tuple(r["y"])) for r in windows.collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected(rows, 3, 0)


def test_short_lists_are_dealt_out_once(spark):
    """Lists with gaps, a full segment, too few entries, and rows without list or place."""
    rows = [(p, i * (1 + p % 3), (p * 7 + i * i) % 5) for p in range(40) for i in range(p)]
    rows += [(99, i, 1 + i % 9) for i in range(segments.WIDTH)] + [(None, i, 4) for i in range(8)] + [(98, None, 4)] * 8
    check(spark, rows, joins=False)


def test_lists_beyond_one_segment_are_numbered_across(spark):
    """List 5 loses most of its second segment; list 6 begins behind the first."""
    width = segments.WIDTH
    rows = [(5, i, 0 if width <= i < 2 * width - 2 else 1 + i % 11) for i in range(2 * width + 9)]
    rows += [(6, width + i, 1 + i) for i in range(7)] + [(7, i, 1 + i) for i in range(9)]
    check(spark, rows, joins=True)
