"""The mirror over restarts, and plugin hooks from SQL."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import hooks
from marlstone.sources import mirror
from marlstone.sources.stored import fresh_path


def test_mirror(spark):
    """Rows of equal times over restarts arrive once, none is lost; a malformed row stops the mirror until it is mended."""
    feed, target, check = (fresh_path(spark, n) for n in ("feed", "mirror", "check"))
    rows = lambda *xs: [(t, s, k, r, "new", json.dumps({"v": s})) for t, s, k, r in xs]
    add = lambda part, name: spark.createDataFrame(part, mirror.FEED).coalesce(1).write.mode("overwrite").parquet(f"{feed}/{name}")
    held = lambda: sorted((r.micros, r.seq, r.key, r.revision) for r in spark.read.parquet(target).collect())
    one = rows((10, 1, "a", 1), (20, 2, "b", 1), (20, 3, "a", 2))
    add(one, "p1")
    mirror.mirror(spark, feed, target, check, 3)
    assert held() == sorted(x[:4] for x in one)
    mirror.mirror(spark, feed, target, check, 3)  # nothing new
    two = rows((20, 4, "c", 1), (20, 0, "d", 1))  # late rows of the resume point's own time, one of a lesser sequence
    add(two, "p2")
    mirror.mirror(spark, feed, target, check, 3)
    assert held() == sorted(x[:4] for x in one + two)
    three = rows((30, 5, "a", 3), (31, 6, "e", 1))
    bad = [(32, 7, None, 1, "new", "{}"), (33, 8, "f", 1, "new", "{not json")]
    add(three + bad, "p3")
    for _ in range(2):
        with pytest.raises(Exception, match="malformed"):
            mirror.mirror(spark, feed, target, check, 3)
        assert held() == sorted(x[:4] for x in one + two)  # nothing of the batch is in
    mended = rows((32, 7, "g", 1), (33, 8, "f", 1))
    add(three + mended, "p3")
    mirror.mirror(spark, feed, target, check, 3)
    assert held() == sorted(x[:4] for x in one + two + three + mended)
    again = rows((40, 9, "a", 3), (40, 9, "a", 4))  # a revision that comes twice
    add(again, "p4")
    mirror.mirror(spark, feed, target, check, 3)
    assert held() == sorted(x[:4] for x in one + two + three + mended + again[1:])
    assert mirror.may_advance(True, 0) and not mirror.may_advance(False, 0) and not mirror.may_advance(True, 1)


def test_hooks(spark):
    hooks.register_hooks(spark)
    rows = [(1, "a", '{"count": 3, "dataset": "x", "k": 1}'), (2, "a", '{"count": 0}'), (3, "a", '{"count": "many"}'), (4, "b", "not json"), (5, "b", None), (6, "b", '{"count": 9, "extra": "é"}'), (7, "b", "[1]")]
    spark.createDataFrame(rows, "id int, grp string, body string").createOrReplaceTempView("hooked")
    ask = lambda pre, post, params: spark.sql(f"select * from plugin_hooks(table(hooked) partition by (grp) order by (id), 'body', {pre}, {post}, '{json.dumps(params)}')").collect()
    out = ask("'gate'", "'slim'", {"min_count": 2, "keep": ["k", "count"]})
    got = {r.id: (r.verdict, r.shaped, bool(r.error)) for r in out if r.hook_kind == "row"}
    assert got == {1: ("pass", '{"count":3,"k":1,"slimmed":true}', False), 2: ("stop", None, False), 3: ("open", '{"count":"many","slimmed":true}', True), 4: ("open", '{"slimmed":true}', True), 5: ("open", '{"slimmed":true}', True), 6: ("pass", '{"count":9,"slimmed":true}', False), 7: ("open", '{"slimmed":true}', True)}
    stats = sorted((r.calls, r.errors) for r in out if r.hook_kind == "stats")
    assert sum(c for c, _ in stats) == 13 and sum(e for _, e in stats) == 4 and all(r.micros >= 0 for r in out if r.hook_kind == "stats")
    plain = {r.id: (r.verdict, r.shaped, r.error) for r in ask("null", "null", {}) if r.hook_kind == "row"}
    assert plain == {i: ("pass", b, None) for i, _, b in rows}
    assert hooks.passes(True) is True and hooks.passes({"pass": False}) is False and hooks.passes({"pass": "yes"}) is None and hooks.passes([1]) is None
    for pre, body in (("'nosuch'", "'body'"), ("null", "'nocolumn'")):
        with pytest.raises(Exception, match="no plugin|no column"):
            spark.sql(f"select * from plugin_hooks(table(hooked) partition by (grp), {body}, {pre}, null, '{{}}')").collect()
    spark.sql("select *, 1 as verdict from hooked").createOrReplaceTempView("clashing")
    with pytest.raises(Exception, match="result's names"):
        spark.sql("select * from plugin_hooks(table(clashing), 'body', null, null, '{}')").collect()
    empty = spark.createDataFrame([], "id int, grp string, body string")
    empty.createOrReplaceTempView("hooked")
    assert ask("'gate'", "null", {}) == []
