"""Name resolution: keys, pair scores, clusters under constraints, alias closure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from worktide.functions import text as T
from worktide.sources.sinks import stored

MERGE, ASK = 1.0, 0.35
VETO = float("-inf")


def same_key_groups(names: DataFrame, name: str) -> DataFrame:
    """Names that are the same but for case and separators: canon is the longest,
    then the first."""
    keyed = names.select(name, T.identity_key(F.col(name)).alias("key")).where("key <> ''").distinct()
    canon = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.length(name)).alias("l"), F.col(name).alias("x")))["x"].alias("canon")).where("n > 1").drop("n")
    return keyed.join(canon, "key").where(F.col(name) != F.col("canon")).select(F.col(name).alias("alias"), "canon")


def candidate_pairs(names: DataFrame, name: str) -> DataFrame:
    """a < b of names that share a bigram, each pair once. The names are a small
    dimension: a bigram that many of them hold makes the square of their number."""
    grams = names.select(F.col(name).alias("n"), F.explode(T.bigrams(F.col(name))).alias("gram")).distinct()
    left, right = grams.select(F.col("n").alias("a"), "gram"), grams.select(F.col("n").alias("b"), "gram")
    return left.join(right, "gram").where("a < b").select("a", "b").distinct()


def similar_pairs(names: DataFrame, name: str, least: float) -> DataFrame:
    """a < b and dice of names whose bigrams are alike by more than ``least``.

    Two sets of more than that share one of the n - ceil(least * n / (2 - least)) + 1
    rarest bigrams of either; only those are joined, so a common bigram hardly ever
    makes pairs. Then the whole sets are compared."""
    own = names.select(F.col(name).alias("n")).distinct().withColumn("grams", T.bigrams(F.col("n")))
    each = own.select("n", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    rare = each.join(each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram")
    place = F.row_number().over(W.partitionBy("n").orderBy("df", "gram"))
    kept = F.col("size") - F.ceil(F.col("size") * (least / (2 - least)) - 1e-9) + 1
    prefix = rare.withColumn("place", place).where(F.col("place") <= kept).select("n", "gram")
    met = prefix.withColumnRenamed("n", "a").join(prefix.withColumnRenamed("n", "b"), "gram").where("a < b").select("a", "b").distinct()
    both = met.join(own.select(F.col("n").alias("a"), F.col("grams").alias("ga")), "a").join(own.select(F.col("n").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", T.dice(F.col("ga"), F.col("gb")).alias("dice")).where(F.col("dice") > least)


def sharing_pairs(names: DataFrame, name: str) -> DataFrame:
    """a < b and jaccard of names that share a word, joined on words."""
    own = names.select(F.col(name).alias("n")).distinct().withColumn("words", T.tokens(F.col("n")))
    each = own.select("n", "words", F.explode("words").alias("word"))
    met = each.select(F.col("n").alias("a"), F.col("words").alias("wa"), "word").join(each.select(F.col("n").alias("b"), F.col("words").alias("wb"), "word"), "word").where("a < b")
    shared = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.first(F.size("wa") + F.size("wb")).alias("both"))
    return shared.select("a", "b", (F.col("common") / (F.col("both") - F.col("common"))).alias("jaccard"))


def pair_scores(pairs: DataFrame, profiles: DataFrame, never: DataFrame | None = None, half_days: int = 14, refined: DataFrame | None = None) -> DataFrame:
    """a, b, score, band. profiles: name, details (array), first_day, last_day,
    pinned, product; never: pairs that must stay apart; refined: pairs that were once
    refined together; half_days: at least 14 and half the period's days. Vetoes come first: marked never, other note, other numbers;
    then the same key, then both pinned; then the weighted evidence."""
    p = profiles.withColumns({"key": T.identity_key(F.col("name")), "note": T.note(F.col("name")), "nums": T.numbers(F.col("name")), "grams": T.bigrams(F.col("name")), "toks": T.tokens(F.col("name"))})
    one, two = (p.select(*(F.col(c).alias(f"{side}_{c}") for c in p.columns)) for side in "ab")
    rows = pairs.join(one, F.col("a") == F.col("a_name")).join(two, F.col("b") == F.col("b_name"))
    if never is None:
        rows = rows.withColumn("_never", F.lit(False))
    else:
        marked = never.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("_never")).distinct()
        rows = rows.join(marked, ["a", "b"], "left").na.fill(False, ["_never"])
    if refined is None:
        rows = rows.withColumn("_refined", F.lit(False))
    else:
        together = refined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("_refined")).distinct()
        rows = rows.join(together, ["a", "b"], "left").na.fill(False, ["_refined"])
    same = F.col("a_product").isNotNull() & (F.col("a_product") == F.col("b_product"))
    return rows.withColumn("score", evidence_score(same, F.lit(half_days))).select("a", "b", "score").withColumn("band", band())


def band() -> Column:
    return F.when(F.col("score") == VETO, "veto").when(F.col("score") >= MERGE, "merge").when(F.col("score") >= ASK, "ask").otherwise("apart")


def evidence_score(same_product: Column, half_days: Column) -> Column:
    """The score of joined profiles (columns a_ and b_, _never, _refined)."""
    name = T.dice(F.col("a_grams"), F.col("b_grams"))
    details = T.jaccard(F.col("a_details"), F.col("b_details"))
    exclusive = (details == 0) & (F.size("a_details") >= 2) & (F.size("b_details") >= 2)
    common, sa, sb = F.size(F.array_intersect("a_toks", "b_toks")), F.size("a_toks"), F.size("b_toks")
    subset = ((common == sa) | (common == sb)) & (F.abs(sa - sb) >= 2)
    apart = F.date_diff(F.greatest("a_first_day", "b_first_day"), F.least("a_last_day", "b_last_day"))
    evidence = (
        F.when(name > 0.45, 2.4 * (name - 0.45)).otherwise(0.0)
        + F.when(details > 0, 2.0 * details).when(exclusive, -0.8).otherwise(0.0)
        + F.when(F.col("_refined"), 1.0).otherwise(0.0)
        + F.when(same_product, 1.2).otherwise(0.0)
        - F.when(subset, 0.5).otherwise(0.0)
        - F.when(apart >= half_days, 0.6).otherwise(0.0)
    )
    return (
        F.when(F.col("_never") | (F.col("a_note") != F.col("b_note")) | (F.col("a_nums") != F.col("b_nums")), F.lit(VETO))
        .when(F.col("a_key") == F.col("b_key"), 10.0)
        .when(F.col("a_pinned") & F.col("b_pinned"), F.lit(VETO))
        .otherwise(F.round(evidence, 6))
    )


def scopes(scores: DataFrame, names: DataFrame) -> DataFrame:
    """name, scope: the least name of those that pairs of positive score link.

    Clustering gains nothing across such components, so each is a problem of its
    own. Large and small stars; the names are a small dimension.
    """

    def state(edges: DataFrame) -> tuple:
        whole = lambda h: F.sum(h.cast("decimal(20,0)"))
        return tuple(edges.agg(F.count(F.lit(1)), whole(F.xxhash64("node", "root")), whole(F.xxhash64(F.lit(1), "root", "node"))).first())

    stars = stored(scores.where("score > 0").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    before = None
    while (now := state(stars)) != before:
        before = now
        both = stars.select(F.col("node").alias("x"), F.col("root").alias("y")).union(stars.select(F.col("root").alias("x"), F.col("node").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("node"), F.col("m").alias("root")).distinct()
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(low, "node").where("root != m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        stars = stored(small.union(low.select("node", F.col("m").alias("root"))).distinct())
    return names.select("name").join(stars.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("root", "name").alias("scope"))


def clusters(scores: DataFrame, names: DataFrame, cap: int = 5, scope: str = "scope") -> DataFrame:
    """scope, name, canon: correlation clustering within each scope.

    Names in order of weight, then alphabet, take up the names behind them with a
    merge score; then, in up to six rounds, each name makes the first single move
    that lowers the cost. No cluster holds
    a vetoed pair or more than ``cap`` names. scores: scope, a, b, score; names:
    scope, name, weight. A scope is a group of linked names (``scopes``) or one
    project's names. With a column seed, names of one seed start as a cluster, which
    only the seed itself adds to, and stay in it.
    """
    seeded = "seed" in names.columns

    def solve(key, pairs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        weight = {(min(a, b), max(a, b)): s for a, b, s in zip(pairs["a"], pairs["b"], pairs["score"])}
        w = lambda x, y: weight.get((min(x, y), max(x, y)), 0.0)
        order = [n for _, n in sorted(zip(-own["weight"], own["name"]))]
        fits = lambda x, group: len(group) < cap and all(w(x, y) != VETO for y in group)
        groups: list[list[str]] = []
        where: dict[str, int] = {}
        seeds = dict(zip(own["name"], own["seed"])) if seeded else {}
        held = {x for x in order if seeds.get(x)}
        first: dict[str, int] = {}
        for x in (x for x in order if x in held):
            if seeds[x] not in first:
                first[seeds[x]] = len(groups)
                groups.append([])
            where[x] = first[seeds[x]]
            groups[where[x]].append(x)
        for x in order:
            if x in where and seeds.get(x) != x:
                continue
            if x not in where:
                where[x] = len(groups)
                groups.append([x])
            for y in order:
                if y not in where and w(x, y) >= MERGE and fits(y, groups[where[x]]):
                    where[y] = where[x]
                    groups[where[x]].append(y)
        gain = lambda x, g: sum(w(x, y) for y in groups[g] if y != x)
        def move(x: str) -> bool:
            """Move x to the first place that lowers the cost, if there is one."""
            here = gain(x, where[x])
            places = [g for g in range(len(groups)) if g != where[x] and groups[g] and fits(x, groups[g])] + [len(groups)] * (len(groups[where[x]]) > 1)
            for g in places:
                if (gain(x, g) if g < len(groups) else 0.0) > here + 1e-9:
                    groups[where[x]].remove(x)
                    if g == len(groups):
                        groups.append([])
                    groups[g].append(x)
                    where[x] = g
                    return True
            return False

        for _ in range(6):
            if not any([move(x) for x in order if x not in held]):
                break
        rank = {n: i for i, n in enumerate(order)}
        canon = {x: min(groups[g], key=rank.get) for x, g in where.items()}
        return pd.DataFrame({scope: [key[0]] * len(order), "name": order, "canon": [canon[x] for x in order]})

    kind = names.schema[scope].dataType.simpleString()
    return scores.groupBy(scope).cogroup(names.groupBy(scope)).applyInPandas(solve, f"{scope} {kind}, name string, canon string")


def close_aliases(edges: DataFrame, alias: str = "alias", canon: str = "canon", scope: list[str] | None = None, rank: Column | None = None) -> DataFrame:
    """scope, alias, canon: every chain followed to its end, within its scope.

    An alias with several canons takes the least. A chain that runs into a cycle ends
    at the cycle's representative: the node of the least ``rank`` (a column over
    ``canon``; shortest without extra white space, then shortest, then first by
    default), which is nobody's alias. Names that are their own canon are left out.

    Pointer jumping: a round joins the table with itself and doubles each pointer's
    reach. The nodes that pointers within the table lead to become fewer until those
    on cycles are left, which a pointer only permutes; then the rounds stop, however
    long the chains are. The least rank then goes round the cycles in the same way.
    """
    keys = scope or []
    name = F.col(canon)
    rank = rank if rank is not None else F.struct(F.length(F.trim(F.regexp_replace(name.cast("string"), r"\s+", " "))), F.length(name.cast("string")), name)
    held = edges.where(F.col(alias) != F.col(canon)).groupBy(*keys, F.col(alias).alias("x")).agg(F.min(canon).alias("y"))
    first = stored(held)
    inner = first.select(*keys, F.col("x").alias("y")).withColumn("inside", F.lit(True))

    def hop(table: DataFrame) -> DataFrame:
        onward = table.select(*keys, F.col("x").alias("y"), F.col("y").alias("y2"))
        return stored(table.join(onward, [*keys, "y"], "left").select(*keys, "x", F.coalesce("y2", "y").alias("y")))

    def on_table(table: DataFrame) -> DataFrame:
        """The nodes that pointers lead to and that point on themselves."""
        return table.select(*keys, "y").distinct().join(inner, [*keys, "y"], "left_semi")

    reach, left = first, None
    while (now := on_table(reach).count()) and now != left:
        reach, left = hop(reach), now
    if not now:
        return reach.select(*keys, F.col("x").alias(alias), F.col("y").alias(canon))

    cycle = stored(on_table(reach).withColumnRenamed("y", "x"))
    ranked = stored(first.join(cycle, [*keys, "x"], "left_semi").withColumn(canon, F.col("x")).select(*keys, "x", "y", rank.alias("rank"), F.col("x").alias("name")))
    state = lambda t: t.agg(F.sum(F.xxhash64(*keys, "x", "name").cast("decimal(20,0)"))).first()[0]
    before, best = None, ranked.select(*keys, "x", "y", F.struct("rank", "name").alias("best"), "name")
    while (after := state(best)) != before:
        onward = best.select(*keys, F.col("x").alias("y"), F.col("y").alias("y2"), F.col("best").alias("best2"))
        both = best.join(onward, [*keys, "y"]).select(*keys, "x", F.col("y2").alias("y"), F.least("best", "best2").alias("best"))
        before, best = after, stored(both.withColumn("name", F.col("best.name")))
    heads = best.select(*keys, F.col("x").alias("y"), F.col("name").alias("head"))
    out = reach.join(heads, [*keys, "y"], "left").select(*keys, F.col("x").alias(alias), F.coalesce("head", "y").alias(canon))
    return out.where(F.col(alias) != F.col(canon))


def canonical(rows: DataFrame, column: str, aliases: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``rows`` with a name replaced by its canon, in scope where given."""
    keys = scope or []
    table = aliases.select(*keys, F.col("alias").alias(column), F.col("canon").alias("_canon"))
    return rows.join(table, [*keys, column], "left").withColumn(column, F.coalesce("_canon", column)).drop("_canon")


def cascade(rows: DataFrame, column: str, pool: DataFrame, name: str) -> DataFrame:
    """Resolve names against a pool on ever looser axes, each only where it names
    one entry: exact, lower case, folded, without spaces, without note."""
    axes = {"exact": lambda c: c, "lower": F.lower, "fold": T.fold, "key": T.identity_key, "noteless": lambda c: T.identity_key(T.without_note(c))}
    out, found = rows, []
    for axis, key in axes.items():
        table = pool.groupBy(key(F.col(name)).alias(f"_{axis}")).agg(F.count_distinct(name).alias("_n"), F.min(name).alias(f"_to_{axis}")).where("_n = 1").drop("_n")
        out = out.join(table, key(F.col(column)) == F.col(f"_{axis}"), "left").drop(f"_{axis}")
        found.append((axis, F.col(f"_to_{axis}")))
    how = F.lit(None).cast("string")
    for axis, c in reversed(found):
        how = F.when(c.isNotNull(), axis).otherwise(how)
    return out.withColumns({"resolved": F.coalesce(*(c for _, c in found)), "axis": how}).drop(*(f"_to_{a}" for a in axes))


MIN_PREFIX = 8


def plain(name: Column) -> Column:
    """Lower case, one space between words; separators stay."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))


def without_dash(name: Column) -> Column:
    """Without an explanation behind a dash that stands between spaces."""
    return F.trim(F.regexp_replace(name, r"\s+[-\u2013\u2014]\s+.*$", ""))


def joined(name: Column) -> Column:
    return F.regexp_replace(name, " ", "")


def prefixes(name: Column) -> Column:
    """What a name begins with, of MIN_PREFIX letters at least, up to where a word ends."""
    text = plain(name)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: (i >= MIN_PREFIX) & ((i == F.length(text)) | ~F.substr(text, i + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")))
    return F.transform(ends, lambda i: F.substr(text, F.lit(1), i))


def axes(detail: Column | None) -> list[tuple[str, object, object]]:
    """Ever looser ways to compare: name, key of what was said, keys of an entry."""
    one = lambda f: lambda c: F.array(f(c))
    bare = lambda c: T.without_note(without_dash(plain(c)))
    ways = [
        ("exact", lambda c: c, one(lambda c: c)), ("lower", F.lower, one(F.lower)), ("fold", T.fold, one(T.fold)), ("plain", plain, one(plain)), ("dashless", lambda c: without_dash(plain(c)), one(plain)),
        ("dashless joined", lambda c: joined(without_dash(plain(c))), one(lambda c: joined(plain(c)))), ("key", T.identity_key, one(T.identity_key)), ("noteless", bare, one(bare)),
        ("prefix", lambda c: F.when(F.length(F.regexp_replace(plain(c), "[. ]+$", "")) >= MIN_PREFIX, F.regexp_replace(plain(c), "[. ]+$", "")), prefixes),
    ]
    return ways if detail is None else [*ways, ("detail", T.identity_key, lambda _: F.array(T.identity_key(detail)))]


def resolve_scoped(said: DataFrame, raw: str, pool: DataFrame, name: str, scope: str, detail: str | None = None) -> DataFrame:
    """said's rows with resolved and axis: the entry of the scope's pool that ``raw``
    means, by the first axis on which its key is one entry's alone; null without one.

    All axes are one table of (scope, axis, key): entries are told unique by one
    aggregate, and both sides meet in one join, however many axes there are. On the
    axis without notes, what was said may lack the entry's note but not have another."""
    ways = axes(F.col("part") if detail else None)
    own = pool.select(F.col(scope).alias("s"), F.col(name).alias("entry"), F.col(detail or name).alias("part"))
    spread = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), of(F.col("entry")).alias("keys")) for i, (_, _, of) in enumerate(ways))))
    each = stored(own.withColumn("w", spread).select("s", "entry", "w.i", F.explode("w.keys").alias("key")).where("key <> ''"))
    single = each.groupBy("s", "i", "key").agg(F.min("entry").alias("entry"), F.max("entry").alias("last")).where("entry = last").drop("last")
    distinct = said.select(F.col(scope).alias("s"), F.col(raw).alias("raw")).distinct()
    asked = distinct.withColumn("keys", F.array(*(of(F.col("raw")) for _, of, _ in ways))).select("s", "raw", F.posexplode("keys").alias("i", "key")).where("key <> ''")
    note = lambda c: F.trim(F.lower(T.note(F.col(c))))
    noteless = next(i for i, (w, _, _) in enumerate(ways) if w == "noteless")
    fits = (F.col("i") != noteless) | (note("raw") == "") | (note("raw") == note("entry"))
    found = asked.join(single, ["s", "i", "key"]).where(fits).groupBy("s", "raw").agg(F.min(F.struct("i", "entry")).alias("hit"))
    names = F.element_at(F.array(*(F.lit(w) for w, _, _ in ways)), F.col("hit.i") + 1)
    table = found.select(F.col("s").alias(scope), F.col("raw").alias(raw), F.col("hit.entry").alias("resolved"), names.alias("axis"))
    return said.join(table, [scope, raw], "left")
