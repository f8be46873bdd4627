import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellore.llm import survivors as sv


def test_times_in_all_spellings(spark):
    rows = [
        ("2024-11-03 17:19:08.847", 1730654348847), ("2024-11-03T17:19:08.847Z", 1730654348847), ("2024-11-03T19:19:08.847+02:00", 1730654348847),
        (" 1730654348847 ", 1730654348847), ("2024-11-03T17:19:08", 1730654348000), ("2024-11-03T12:19:08-0500", 1730654348000),
        ("unknown", None), ("", None), (None, None), ("2024-13-40T00:00:00Z", None), ("17:19", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.select(sv.instant_ms(F.col("t")).alias("ms"), "i").orderBy("i").collect()] == [ms for _, ms in rows]


cand = st.fixed_dictionaries({"x": st.sampled_from([None, "1", "2"]), "y": st.sampled_from(["a", "b", None])})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(cand, max_size=4), min_size=1, max_size=3))
def test_branch_and_bound_against_all_choices(lists):
    lists = [[{**c, "rank": i + 1, "member": i} for i, c in enumerate(x)] for x in lists]
    rule = [sv.Dependency(("x",), ("y",))]
    chosen, proven = sv.branch_and_bound(lists, [False] * len(lists), rule)
    best = None
    for pick in itertools.product(*[x or [None] for x in lists]):
        there = [p for p in pick if p is not None]
        if all(p["x"] is None or p["x"] != q["x"] or p["y"] == q["y"] for p, q in itertools.combinations(there, 2)):
            trust = sum(1 / p["rank"] for p in there)
            best = trust if best is None else max(best, trust)
    assert proven
    assert (chosen is None) == (best is None)
    if chosen is not None:
        assert abs(sum(1 / c["rank"] for c in chosen if c is not None) - best) < 1e-9


PAGES = "page_id bigint, url string, slug string, source string, section string, title string, discovered_via string, updated_at string, body_md string, body_md_chars int, raw_body_chars int, revision string, excerpt string, group_id int"


def page(i, url, via=None, at=None, body="b", excerpt=None):
    return (i, url, "s", "src", "sec", "t", via, at, body, 1, 1, "1", excerpt, 0)


def test_page_survivors(spark):
    rows = [
        page(1, "http://b", "link_bfs", "2024-01-01T00:00:00Z", "body", "  "),
        page(2, "http://c", " SIDEBAR ", "unknown", "body longer", "ex"),
        page(3, "http://d", "sidebar", "2024-01-01 00:00:00.000", "body!", "ex"),
        page(4, "http://a", None, None, None, None),
        page(7, None, None, None, "x", ""),
        page(8, "http://e", None, "1", "xy", None),
        page(9, "http://z", None, None, "solo", "solo"),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 9)], "page_id bigint, group_id bigint")
    members = sv.page_members(pages, groups)
    chosen = sv.choose_bundles(members, sv.page_bundles())
    assert {tuple(r) for r in chosen.collect()} == {(1, "url", 2), (1, "body_md", 3), (1, "excerpt", 2), (7, "url", 8), (7, "body_md", 8)}
    records = {r["group_id"]: r for r in sv.surviving_records(pages, chosen, sv.page_bundles()).collect()}
    assert (records[1]["url"], records[1]["body_md"], records[1]["excerpt"]) == ("http://c", "body!", "ex")
    assert records[7]["excerpt"] is None


def test_dependency_beyond_the_first_candidates(spark):
    """One hot group in which only the 40th choice of the second bundle agrees with the first's best."""
    rows = [(5, i, i, 100 - i, "k", "same" if i in (0, 60) else f"v{i}") for i in range(100)]
    members = spark.createDataFrame(rows, "group_id bigint, member bigint, up int, down int, x string, y string")
    bundles = [sv.Bundle("first", ("up",), (F.col("up"),)), sv.Bundle("second", ("down",), (F.col("down"),))]
    free = {r["bundle"]: r["member"] for r in sv.choose_bundles(members, bundles).collect()}
    assert free == {"first": 0, "second": 99}
    tied = {r["bundle"]: r["member"] for r in sv.choose_bundles(members, bundles, [sv.Dependency(("x",), ("y",))], depth=2).collect()}
    best = max(((1 / (a + 1) + 1 / (100 - b), -a) for a in range(100) for b in range(100) if rows[a][5] == rows[b][5]))
    assert abs(1 / (tied["first"] + 1) + 1 / (100 - tied["second"]) - best[0]) < 1e-9


def test_contradictory_bundles_give_up_the_last(spark):
    rows = [(1, 1, "k", "a", True), (1, 2, "k", "b", False)]
    members = spark.createDataFrame(rows, "group_id bigint, member bigint, x string, y string, first boolean")
    bundles = [sv.Bundle("one", (), (F.col("member"),), F.col("first")), sv.Bundle("two", (), (F.col("member"),), ~F.col("first"))]
    assert {tuple(r) for r in sv.choose_bundles(members, bundles, [sv.Dependency(("x",), ("y",))]).collect()} == {(1, "one", 1)}


def test_no_groups(spark):
    pages = spark.createDataFrame([], PAGES)
    groups = spark.createDataFrame([], "page_id bigint, group_id bigint")
    assert sv.choose_bundles(sv.page_members(pages, groups), sv.page_bundles()).count() == 0


def test_the_place_goes_with_the_address(spark):
    """The fullest place is another member's, but the address brings its own site and slug."""
    rows = [(1, 1, "u1", "a", "s", "x", 5), (1, 2, "u2", "b", "s", "x", 1), (1, 3, "u3", "b", "s", "x", 3), (1, 4, "u4", "b", "t", "x", 9), (2, 7, None, "a", "s", "x", 1), (2, 8, None, "c", "s", "x", 4)]
    members = spark.createDataFrame(rows, "group_id bigint, member bigint, url string, source string, section string, slug string, filled int")
    bundles = [sv.Bundle("url", ("url",), (F.asc_nulls_last(F.when(F.col("member") == 2, "0").otherwise(F.col("url"))),), weight=sv.CHOSEN), sv.Bundle("place", ("source",), (F.desc("filled"),))]
    chosen = sv.choose_bundles(members, bundles, sv.page_dependencies(), ranks=True)
    assert {tuple(r) for r in chosen.collect()} == {(1, "url", 2, 1), (1, "place", 3, 3), (2, "url", 7, 1), (2, "place", 8, 1)}


def test_a_bound_bundle_in_a_hot_group(spark):
    """Thousands of members with places of their own: one candidate is enough, without a deeper search."""
    rows = [(1, i, f"u{i:05d}", "a", "s", f"x{i % 900}", 5_000 - i) for i in range(5_000)]
    members = spark.createDataFrame(rows, "group_id bigint, member bigint, url string, source string, section string, slug string, filled int")
    bundles = [sv.Bundle("url", ("url",), (F.desc("url"),), weight=sv.CHOSEN), sv.Bundle("place", ("source",), (F.desc("filled"),))]
    gathered = sv._candidates(members, bundles, sv.page_dependencies(), ["section", "slug", "source", "url"], sv.DEPTH).first()
    assert len(gathered["candidates"]) <= 2 * sv.DEPTH + 2
    got = {r["bundle"]: (r["member"], r["rank"]) for r in sv.choose_bundles(members, bundles, sv.page_dependencies(), ranks=True).collect()}
    assert got == {"url": (4_999, 1), "place": (499, 500)}
