"""The best representative of each duplicate group, built from consistent bundles.

Fields that depend on each other (an address, a body and its counts) form a bundle and are taken from one
member together. Each bundle has its own order of preference and a weight; the member in place r has the
trust weight/r. Functional dependencies X -> Y may hold across bundles, in one of two ways. Between any
two chosen members: those that agree in X must agree in Y. Or for the record that is built: where the
bundle ``given`` brings X and the bundle ``bound`` brings Y, the Y of the record must be the one that goes
with its X, so the two members must agree in Y. Per group, branch and bound picks one member for each
bundle so that the trust is greatest and no dependency is broken.

The search sees only the best candidates of each bundle (`DEPTH` of them; of a bound bundle the best one
for each Y that the candidates of its giving bundle have), so a group of any size is a few rows in one
place; their ranking is cut down before the shuffle. Where members beyond these could still give a better
choice the group is searched again with four times the depth, until the choice is proven or the
candidates are exhausted: the result is always that of the full search.

Defined results: ties go to the smallest id; a bundle whose ``usable`` condition holds for no member is
left empty; dependencies whose left side is null don't bind; if no choice satisfies all dependencies, the
bundles that come later in the list are left empty first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellore.runtime import checkpoint, is_blank, strip

DEPTH = 4


@dataclass(frozen=True)
class Bundle:
    """Fields that belong together, the order of preference of their source, and which members can be it."""

    name: str
    fields: tuple[str, ...]
    order: tuple[Column, ...]
    usable: Column | None = None
    weight: float = 1.0


@dataclass(frozen=True)
class Dependency:
    """``left`` determines ``right``: for any two chosen members, or for what ``given`` and ``bound`` bring to the record."""

    left: tuple[str, ...]
    right: tuple[str, ...]
    given: str | None = None
    bound: str | None = None
    columns: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "columns", self.left + self.right)


def instant_ms(text: Column) -> Column:
    """A time in one of its spellings as milliseconds since 1970; no zone means UTC; null if unreadable."""
    t = strip(text)
    stamp = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
    zoned = F.when(t.rlike(stamp + "$"), F.concat(t, F.lit("Z"))).when(t.rlike(stamp + r" ?(Z|[+-]\d{2}:?\d{2})$"), t).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z")))
    zoned = F.regexp_replace(zoned, r" ?([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(t.rlike(r"^-?\d{9,15}$"), t.try_cast("bigint")).otherwise(F.unix_millis(zoned.try_cast("timestamp")))


def agree(d: Dependency, a: dict, b: dict, names: tuple[str | None, str | None]) -> bool:
    """Whether two chosen members, of the bundles named, keep a dependency."""
    if d.given is None:
        binds = all(a[x] is not None and b[x] is not None and a[x] == b[x] for x in d.left)
    else:
        source = {(d.given, d.bound): a, (d.bound, d.given): b}.get(names)
        binds = source is not None and all(source[x] is not None for x in d.left)
    return not binds or all(a[y] == b[y] for y in d.right)


def branch_and_bound(candidates: list[list[dict]], more: list[bool], dependencies: list[Dependency], names: list[str] | None = None, weights: list[float] | None = None) -> tuple[list[dict | None] | None, bool]:
    """The best consistent choice of one candidate per bundle, and whether it is proven.

    ``candidates`` are in order of preference with a ``rank`` each; ``more`` tells where unseen ones
    follow. A bundle without candidates stays empty.
    """
    n = len(candidates)
    names, weights = names or [None] * n, weights or [1.0] * n
    top = [w / c[0]["rank"] if c else 0.0 for w, c in zip(weights, candidates)]
    rest = [sum(top[i:]) for i in range(n + 1)]
    best: list = [None, -1.0]

    def search(i: int, chosen: list[dict | None], trust: float) -> None:
        if trust + rest[i] <= best[1]:
            return
        if i == n:
            best[0], best[1] = list(chosen), trust
            return
        if not candidates[i]:
            search(i + 1, [*chosen, None], trust)
        for c in candidates[i]:
            own = weights[i] / c["rank"]
            if trust + own + rest[i + 1] <= best[1]:
                break
            if all(agree(d, old, c, (names[j], names[i])) for j, old in enumerate(chosen) if old is not None for d in dependencies):
                search(i + 1, [*chosen, c], trust + own)

    search(0, [], 0.0)
    # a choice with an unseen candidate has at most its trust and the best of the others
    unseen = [w / (c[-1]["rank"] + 1) + rest[0] - top[i] for i, (w, c) in enumerate(zip(weights, candidates)) if more[i] and c]
    return best[0], all(u <= best[1] for u in unseen) if best[0] is not None else not unseen


def _choose(bundles: list[tuple[str, float]], dependencies: list[Dependency], columns: list[str]):
    names, weights = [n for n, _ in bundles], [w for _, w in bundles]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for group, listed in zip(batch["group_id"], batch["candidates"]):
                by: dict[str, list[dict]] = {n: [] for n in names}
                more = dict.fromkeys(names, False)
                for c in listed:
                    if c["seen"]:
                        by[c["bundle"]].append({"rank": c["rank"], "member": c["member"], **dict(zip(columns, c["fields"]))})
                    else:
                        more[c["bundle"]] = True
                lists = [sorted(by[n], key=lambda c: c["rank"]) for n in names]
                chosen, proven = branch_and_bound(lists, [more[n] for n in names], dependencies, names, weights)
                while chosen is None and proven:  # contradictory: give up bundles from the last
                    last = max(i for i, x in enumerate(lists) if x)
                    lists[last] = []
                    chosen, proven = branch_and_bound(lists, [more[n] and bool(x) for n, x in zip(names, lists)], dependencies, names, weights)
                for name, c in zip(names, chosen or [None] * len(names)):
                    rows.append((group, name, None if c is None else c["member"], None if c is None else c["rank"], proven))
            out = pd.DataFrame(rows, columns=["group_id", "bundle", "member", "rank", "proven"])
            yield out.astype({"member": "Int64", "rank": "Int32"})

    return choose


def _candidates(todo: DataFrame, bundles: list[Bundle], dependencies: list[Dependency], columns: list[str], depth: int) -> DataFrame:
    """The candidates of each bundle, with a row that is not ``seen`` where others follow."""
    fields = F.array(*(F.col(c).cast("string") for c in columns)) if columns else F.array().cast("array<string>")
    lists: dict[str, DataFrame] = {}
    for b in bundles:
        ranked = (todo.filter(b.usable) if b.usable is not None else todo).withColumn("rank", F.row_number().over(W.partitionBy("group_id").orderBy(*b.order, "member")))
        tie = next((d for d in dependencies if d.bound == b.name), None)
        if tie is None:
            best = ranked.filter(F.col("rank") <= depth + 1).withColumn("seen", F.col("rank") <= depth)
        else:  # the best one for each right side among the giving bundle's candidates
            right = F.to_json(F.struct(*tie.right))
            wanted = lists[tie.given].filter("seen").select("group_id", F.col(f"right_{b.name}").alias("right"), F.lit(True).alias("wanted")).distinct()
            ranked = ranked.withColumn("right", right).withColumn("place", F.row_number().over(W.partitionBy("group_id", "right").orderBy("rank")))
            best = ranked.filter("place = 1").join(wanted, ["group_id", "right"], "left").filter("rank = 1 OR wanted").withColumn("seen", F.lit(True))
        rights = [F.to_json(F.struct(*d.right)).alias(f"right_{d.bound}") for d in dependencies if d.given == b.name]
        lists[b.name] = best.select("group_id", F.lit(b.name).alias("bundle"), "rank", "member", fields.alias("fields"), "seen", *rights)
    every = None
    for x in lists.values():
        x = x.select("group_id", "bundle", "rank", "member", "fields", "seen")
        every = x if every is None else every.unionByName(x)
    # at most depth + 1 rows of each bundle
    return every.groupBy("group_id").agg(F.collect_list(F.struct("bundle", "rank", "member", "fields", "seen")).alias("candidates"))


def choose_bundles(members: DataFrame, bundles: list[Bundle], dependencies: list[Dependency] = (), depth: int = DEPTH, ranks: bool = False) -> DataFrame:
    """group_id, bundle, member (and its rank, if asked for): the member each bundle of each group is taken from.

    ``members`` has group_id, member (unique in its group) and the columns that orders, conditions and
    dependencies use. Bundles without a usable member give no row.
    """
    dependencies = list(dependencies)
    names = [b.name for b in bundles]
    bound = [d.bound for d in dependencies if d.bound]
    if len(set(bound)) < len(bound) or any(names.index(d.given) > names.index(d.bound) for d in dependencies if d.given):
        raise ValueError("a bundle is bound by one dependency at most, and comes behind the bundle that gives it")
    columns = sorted({c for d in dependencies for c in d.columns})
    wanted = ["group_id", "bundle", "member", *["rank"] * ranks]
    todo, parts = members, []
    while True:
        gathered = _candidates(todo, bundles, dependencies, columns, depth)
        chosen = gathered.mapInPandas(_choose([(b.name, b.weight) for b in bundles], dependencies, columns), "group_id bigint, bundle string, member bigint, rank int, proven boolean")
        if not dependencies:  # the best of each bundle is proven by its bound alone
            parts.append(chosen.filter("member IS NOT NULL").select(*wanted))
            break
        chosen = checkpoint(chosen)
        parts.append(chosen.filter("proven AND member IS NOT NULL").select(*wanted))
        open_ = chosen.filter(~F.col("proven")).select("group_id").distinct()
        if open_.isEmpty():
            break
        todo, depth = todo.join(open_, "group_id", "left_semi"), depth * 4
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


CHOSEN = 8.0  # the weight of the bundles whose best member is wanted by all means: more than all others can give


def page_bundles() -> list[Bundle]:
    """The bundles of page records: address, text, excerpt."""
    sidebar = F.coalesce(F.lower(strip(F.col("discovered_via"))) == "sidebar", F.lit(False))
    return [
        Bundle("url", ("url", "discovered_via"), (F.desc(sidebar.cast("int")), F.asc_nulls_last("url")), weight=CHOSEN),
        Bundle("body_md", ("body_md", "body_md_chars", "raw_body_chars", "updated_at", "revision"), (F.desc_nulls_last(instant_ms(F.col("updated_at"))), F.desc_nulls_last("body_chars")), weight=CHOSEN),
        Bundle("excerpt", ("excerpt",), (F.desc("excerpt_chars"),), F.col("excerpt_chars") > 0, weight=CHOSEN),
    ]


def place_bundle() -> Bundle:
    """Where a page stands: the fullest description of its place, the latest of equals."""
    fields = ("source", "section", "slug", "kind", "title", "category", "parent_slug", "breadcrumb", "hidden", "deprecated", "type")
    return Bundle("place", fields, (F.desc("filled"), F.desc_nulls_last(instant_ms(F.col("updated_at")))))


def record_bundles() -> list[Bundle]:
    """The bundles of whole page records: also its place, its API document and its first sight."""
    return [
        *page_bundles(),
        place_bundle(),
        Bundle("api", ("is_api", "is_reference", "oas", "oas_public_url", "doc_api", "reusable_content", "doc_tutorials", "html_chars", "fullscreen"), (F.desc_nulls_last("oas_chars"),)),
        Bundle("created_at", ("created_at",), (F.asc_nulls_last(instant_ms(F.col("created_at"))),)),
    ]


def page_dependencies() -> list[Dependency]:
    """An address belongs to one site, section and slug: the record's place must be one that goes with its address."""
    return [Dependency(("url",), ("source", "section", "slug"), "url", "place")]


def page_members(pages: DataFrame, groups: DataFrame, whole: bool = False) -> DataFrame:
    """The members of groups of two or more with what the preferences of `page_bundles` look at, but no texts.

    With ``whole`` also what those of `record_bundles` look at, where the table has such columns.
    """
    many = groups.groupBy("group_id").agg(F.count("*").alias("size")).filter("size > 1").select("group_id")
    looked_at = [
        F.col("page_id").alias("member"), "url", "discovered_via", "updated_at",
        F.length("body_md").alias("body_chars"), F.coalesce(F.length(strip(F.col("excerpt"))), F.lit(0)).alias("excerpt_chars"),
    ]
    if whole:
        said = [~is_blank(F.col(c)) for c in ("title", "parent_slug", "category.slug", "category.title")]
        filled = sum((x.cast("int") for x in said), F.coalesce((F.size("breadcrumb") > 0).cast("int"), F.lit(0)))
        looked_at += ["source", "section", "slug", filled.alias("filled"), "created_at", F.length("oas").alias("oas_chars")]
    inside = groups.join(many, "group_id", "left_semi").select("group_id", F.col("page_id").alias("member"))
    return inside.join(pages.select(*looked_at), "member")


def surviving_records(pages: DataFrame, chosen: DataFrame, bundles: list[Bundle]) -> DataFrame:
    """One record per group: each bundle's fields from its member, and that member's id."""
    out = chosen.select("group_id").distinct()
    for b in bundles:
        source = chosen.filter(F.col("bundle") == b.name).select("group_id", F.col("member").alias(f"{b.name}_from"))
        fields = pages.select(F.col("page_id").alias(f"{b.name}_from"), *b.fields)
        out = out.join(source.join(fields, f"{b.name}_from"), "group_id", "left")
    return out
