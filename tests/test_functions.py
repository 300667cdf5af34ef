"""Pure functions: JSON values, rules, pages, fingerprints, filters, text sources."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import dom, fingerprints, jsonv, rules
from marlstone.functions.filters import all_of, parse_filter, parse_filters
from marlstone.operators import derived
from marlstone.sources import texts

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", max_size=2), x, max_size=3), max_leaves=8)


@given(VALUES)
def test_canonical_is_stable(v):
    text = jsonv.canonical(v)
    assert jsonv.canonical(jsonv.parse(text)) == text
    assert jsonv.diff(v, v) == {}


@given(VALUES, VALUES)
def test_diff_is_empty_only_for_equal(a, b):
    if jsonv.diff(a, b) == {} and not (isinstance(a, dict) and isinstance(b, dict)):
        assert jsonv.canonical(a) == jsonv.canonical(b)


def test_json_values():
    assert jsonv.canonical({"b": 1.0, "a": [1, "ü", None, True, 1e20]}) == '{"a":[1,"ü",null,true,1e20],"b":1.0}'
    assert jsonv.diff({"a": {"b": 1, "c": 2}}, {"a": {"b": 1, "c": 3}, "d": [1]}) == {"a.c": {"from": 2, "to": 3}, "d": {"from": None, "to": [1]}}
    assert jsonv.diff(1, 2) == {"$": {"from": 1, "to": 2}}
    assert jsonv.content_hash({"a": 1, "h": {"x": 2}}, ["h.x"]) == jsonv.content_hash({"a": 1, "h": {}})
    assert jsonv.without_path([1], "a.b") == [1]
    assert jsonv.salvage("x") is jsonv.MISSING


def test_filter_grammar():
    assert parse_filter("$.a.b:eq:x:y").value == "x:y"
    assert parse_filters(["", None]) == []
    for bad in ("a:eq:1", "$.a:is:1", "$.a:eq", "$.:eq:1", "$.a:numgte:x"):
        with pytest.raises(ValueError):
            parse_filter(bad)


def test_filter_modes(spark):
    data = ['{"v":5}', '{"v":"5"}', '{"v":5.0}', '{"v":true}', '{"v":null}', "{}", '{"v":{}}', '{"v":[1]}', '{"v":"10"}']
    df = spark.createDataFrame(list(enumerate(data)), "k int, data string")

    def hits(spec, mode):
        return [r.k for r in df.where(all_of([parse_filter(spec)], F.col("data"), mode)).orderBy("k").collect()]

    assert hits("$.v:eq:5", "sql") == [1]
    assert hits("$.v:eq:5", "memory") == [0, 1]
    assert hits("$.v:gte:10", "sql") == [1, 6, 7, 8]
    assert hits("$.v:gte:10", "memory") == [0, 1, 2, 3, 8]
    assert hits("$.v:lte:true", "memory") == [0, 1, 2, 3, 8]
    assert hits("$.v:numgte:5", "sql") == [0, 2]
    assert hits("$.v:contains:", "sql") == list(range(9))
    assert hits("$.v:lte:0", "sql") == [3]


def test_derived_specs():
    a, b = derived.Spec("x", "s", "t"), derived.Spec("x", "t", "u")
    derived.accept([a], b)
    with pytest.raises(ValueError):
        derived.accept([a, b], derived.Spec("x", "u", "s"))
    with pytest.raises(ValueError):
        derived.accept([a, b, derived.Spec("x", "u", "v")], derived.Spec("x", "v", "w"))
    for bad in ({"stale": "count"}, {"a": "avg($.x)"}, {"k": "count"}):
        with pytest.raises(ValueError):
            derived.validate(derived.Spec("x", "s", "t", group_by=("$.k",), aggregates=bad))


PAGE = "<title> A  b </title><div id=main><div class='card c-1a2b3c4d'><h2 class=t>T1</h2><span class=price>$1,200.5</span></div><div class=card><h2 class=t>T2</h2></div><p>one<p>two</div><script>var t='</p>'</script>"


def test_rules():
    rs = rules.RuleSet({
        "t": {"kind": "css", "selector": "#main > .card h2.t", "all": True}, "p": {"kind": "css", "selector": ".price", "transforms": [{"kind": "to_number"}]}, "none": {"kind": "css", "selector": ".no", "transforms": [{"kind": "default", "value": 3}]},
        "items": {"kind": "each", "selector": "div.card", "fields": {"p": {"kind": "css", "selector": ".price"}}}, "x": {"kind": "xpath", "path": "count(//div[@class='card'])"}, "j": {"kind": "json", "pointer": "/a"},
    })
    values, status, inner = rs.extract(PAGE)
    assert (values["t"], values["p"], values["x"], values["none"]) == (["T1", "T2"], 1200.5, 1.0, 3)
    assert values["items"] == [{"p": "$1,200.5"}, {"p": None}] and inner["items.p"] == {"items": 2, "matched": 1}
    assert status["j"] == "error" and status["t"] == "matched"
    for bad in ({}, {"a": {"kind": "const", "value": 1}}, {"a": {"kind": "css", "selector": "a::b"}}, {"a": {"kind": "xpath", "path": "//a[position()<3]"}}, {"a": {"kind": "regex", "pattern": "("}}, {"a": {"kind": "json", "pointer": "a"}}):
        with pytest.raises((ValueError, Exception)):
            rules.RuleSet(bad)


def test_transforms():
    t = lambda v, **k: rules.transform(v, k, "http://e.com/a/")
    assert t(" -5 x", kind="to_number") == -5 and t("A-5", kind="to_number") == 5 and t(True, kind="to_number") is None
    assert t("1e", kind="to_int") == 1 and t(["1", "x"], kind="to_int") == [1, None]
    assert t("a, b", kind="split", sep=",") == ["a", "b"] and t("a,b", kind="split", sep=",", index=5) is None
    assert t("ab", kind="regex_replace", pattern="(a)", **{"with": "$1$1"}) == "aab"
    assert t("b", kind="url_absolute") == "http://e.com/a/b" and t(" ", kind="url_absolute") == " "
    assert t("YES", kind="to_bool") is True and t("?", kind="to_bool") is None


def test_pages():
    root = dom.parse(PAGE)
    assert dom.title(root) == "A b" and dom.visible_text(root) == "T1 $1,200.5 T2 one two"
    assert "## T1" in dom.markdown(root)
    assert dom.hash_stem("css-1a2b3c4d") == "css" and dom.hash_stem("header-feedbed") is None and dom.hash_stem("col-md-6") is None
    assert dom.links(dom.parse("<a href=/x#f>a</a><a href='mailto:x'>b</a><a href='//o.com/'>c</a>"), "http://e.com/p") == ["http://e.com/x", "http://o.com/"]
    assert dom.markdown(dom.parse("<ol><li>a<li>b</ol><blockquote>q</blockquote><pre>x  y</pre>")) == "1. a\n2. b\n\n> q\n\n```\nx  y\n```"
    assert dom.parse(None).children == [] and dom.visible_text(dom.parse("<" * 50)) != ""
    deep = dom.parse("<div>" * 3000 + "x")
    assert dom.visible_text(deep) == "x"


def test_induction():
    found = rules.induce([PAGE, PAGE.replace("T1", "T9"), PAGE])
    assert found["items"]["selector"] == "div.card" and "t" in found["items"]["fields"]
    assert rules.induce(["<p>x</p>"]) is None


def test_fingerprints():
    assert fingerprints.simhash("") == 0 and fingerprints.simhash("a b c") == 0
    assert fingerprints.tokens("Ab é-x 1_2 zz") == ["ab", "é", "zz"]
    a, b = fingerprints.simhash("the quick brown fox jumps over the lazy dog today"), fingerprints.simhash("the quick brown fox jumps over the lazy dog tonight")
    assert bin(a ^ b).count("1") < 20
    assert fingerprints.minhash([]) == [] and len(fingerprints.minhash([1, 2])) == 64


def test_text_sources(tmp_path):
    rules_, delay, maps = texts.robots("Sitemap: http://s\nUser-agent: a\nUser-agent: *\nDisallow: /x\nCrawl-delay: 2\n")
    assert rules_ == [(False, "/x")] and delay == 2 and maps == ["http://s"]
    assert texts.robots_regex("/a*b$") == "^/a.*b$"
    assert texts.csv_columns(["A ", "b"], {"x": ["a"], "y": ["z", "B"]}) == {"x": 0, "y": 1}
    with pytest.raises(ValueError):
        texts.csv_columns(["a"], {"x": ["q"]})
    assert texts.catalog(str(tmp_path / "none.toml")) == []
    (tmp_path / "c.toml").write_text('[[source]]\nname = "a"\n')
    assert texts.catalog(str(tmp_path / "c.toml")) == [{"name": "a"}]


def test_plans():
    from datetime import datetime

    from marlstone.operators import replay

    assert len(replay.firings("*/15 8-9 * * *", datetime(2024, 1, 1), datetime(2024, 1, 2))) == 8
    assert replay.firings("0 0 13 * 5", datetime(2024, 9, 1), datetime(2024, 9, 14))[0].day == 6
    with pytest.raises(ValueError):
        replay.cron_field("70", 0, 59)
    assert replay.decide([], False, "collapse") == "idle" and replay.decide([1, 2], False, "collapse") == "fire" and replay.decide([1], True, "each") == "skip"
    assert replay.bucket_step(0, 0, 0.5, 1, 5) == (False, 0.5) and replay.bucket_step(5, 0, 100, 1, 5) == (True, 4)
    assert replay.yields({"a": [1, 2], "b": {"c": 3, "d": {"e": {"f": 1}}}, "t": True}) == [("a", 2), ("b.c", 3)]


def test_written_dates():
    from marlstone.operators.domain import written_dates

    found = lambda t: [x[1:] for x in written_dates(t.lower())]
    assert found("2024-1-05, 3/4/2025 and Sept. 9th, 2026 or may 1 2027") == [(2024, 1, 5), (2025, 3, 4), (2026, 9, 9), (2027, 5, 1)]
    assert found("2024-01-05T10:00") == [(2024, 1, 5)] and found("12024-01-05 2024-01-051 x2024-01-05 2024-01-05t1 2024_01_05 1999-01-01 jan5 2024") == []
    assert [p for p, *_ in written_dates("on the 2024-01-05")] == [7]


def test_deadlines():
    from marlstone.operators.domain import upcoming_deadline

    now = 1_700_000_000
    assert upcoming_deadline("Deadline: January 5, 2024", now) == 1704412800
    assert upcoming_deadline("deadline" + " " * 130 + "2024-01-05", now) is None
    assert upcoming_deadline("due 2024-02-31", now) is None and upcoming_deadline(None, now) is None


def test_typed_filters_agree(spark):
    from marlstone.sources import records

    rows = [(1, "F", 5.0, 7), (2, "O", None, 10), (3, None, 100.5, 5), (4, "f", -1.0, None)]
    t = spark.createDataFrame(rows, "k int, s string, d double, n long")
    r = records.as_records(t, "a", "b", F.col("k"), F.lit("2024-01-01").cast("timestamp"))
    for spec in ("$.s:eq:F", "$.s:contains:f", "$.s:gte:G", "$.d:gte:5", "$.d:lte:5x", "$.n:eq:7", "$.n:gte:10", "$.n:lte:5", "$.d,$.n:numgte:7", "$.s:contains:"):
        for mode in ("sql", "memory"):
            a, b = (sorted(x.key for x in records.records_view(df, "a", "b", [spec], mode=mode).select("key").collect()) for df in (r, r.drop("value")))
            assert a == b, (spec, mode)


def test_filters_reach_the_scan(spark, capsys):
    from conftest import SMALL

    from marlstone import registry

    registry.QUERIES["filter_sql_ranges"](spark, SMALL).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "o_totalprice" in plan.split("PushedFilters")[1][:300] and "to_json" not in plan
