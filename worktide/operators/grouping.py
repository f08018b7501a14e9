"""Greedy groupings that equal their sequential order, and lookup by containment.

A greedy pass takes names by rank; each joins the first group, in order, that it is
like, or begins one. Where a group keeps its first name, the leaders are those that
no earlier leader is like, and they can be found in rounds: a name that no earlier
undecided name is like leads, and what it is like follows. Likeness is given by
shared keys, so a round is an aggregate by key: no pairs are made, however many names
share a key, and no scope or component is ever one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from worktide.functions import text as T
from worktide.operators import resolve
from worktide.sources.sinks import stored

ALIKE, GRAM = 0.8, 4


def by_key(links: DataFrame) -> DataFrame:
    """key, any_rank, strong_rank: the least rank of all and of strong holders."""
    return links.groupBy("key").agg(F.min("rank").alias("any_rank"), F.min(F.when(F.col("strong"), F.col("rank"))).alias("strong_rank"))


def seen() -> Column:
    """The least rank that a holder of a key is like: a strong one is like all, a
    weak one like the strong."""
    return F.when(F.col("strong"), F.col("any_rank")).otherwise(F.col("strong_rank"))


def greedy_leaders(links: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """node, leader_rank: the rank of the first leader that each node is like.

    links: node, rank (any ordered type, no two nodes alike), key, strong. Two holders
    of a key are like each other if either is strong. fixed: nodes that lead whatever
    they are like. In each round at least the first undecided node is decided, and
    usually most are.
    """
    left = links = stored(links)
    led = None
    chosen = links.join(fixed, "node", "left_semi") if fixed is not None else None
    while True:
        if chosen is None:
            blocked = left.join(by_key(left), "key").groupBy("node").agg(F.max(F.coalesce(seen() < F.col("rank"), F.lit(False))).alias("blocked"))
            chosen = left.join(blocked.where("NOT blocked").select("node"), "node", "left_semi")
        new = stored(chosen)
        led = new if led is None else stored(led.union(new))
        follows = left.join(by_key(new), "key").where(seen() <= F.col("rank")).select("node").distinct()  # leaders with themselves
        gone = follows.union(new.select("node")).distinct()
        left = stored(left.join(gone, "node", "left_anti"))
        if left.isEmpty():
            break
        chosen = None
    own = led.select("node").distinct().withColumn("leads", F.lit(True))
    first = links.join(by_key(led), "key").groupBy("node").agg(F.min(seen()).alias("first"), F.first("rank").alias("rank"))
    return first.join(own, "node", "left").select("node", F.when(F.col("leads"), F.col("rank")).otherwise(F.col("first")).alias("leader_rank"))


def merged_details(rows: DataFrame, scope: str, name: str, weight: str, fixed: DataFrame | None = None) -> DataFrame:
    """scope, name, weight, canon: details of a scope (a project) that name one thing.

    By weight, then name; each takes the first representative with the same note that
    shares two words with it or whose words are all among its own, or the other way
    round. Words are ``detail_words``; a name without any stands alone. fixed: scope,
    name of representatives chosen before, which come first and stay.
    """
    sums = rows.groupBy(scope, name).agg(F.sum(weight).alias(weight))
    node = F.struct(F.col(scope).alias("s"), F.col(name).alias("n"))
    known = sums.withColumns({"node": node, "words": T.detail_words(F.col(name)), "note": F.trim(F.lower(T.note(F.col(name))))})
    if fixed is None:
        known = known.withColumn("fixed", F.lit(False))
    else:
        known = known.join(fixed.select(scope, name).distinct().withColumn("fixed", F.lit(True)), [scope, name], "left").na.fill(False, ["fixed"])
    known = stored(known.withColumn("rank", F.struct((~F.col("fixed")).alias("o"), (-F.col(weight)).alias("w"), F.col(name).alias("n"))))
    pairs = F.expr("flatten(transform(words, (x, i) -> transform(slice(words, i + 2, size(words)), y -> concat(x, '\\n', y))))")
    lone = F.size("words") == 1
    of = known.where(F.size("words") > 0)
    key = lambda kind, text: F.struct(F.col(scope).alias("s"), F.col("note"), F.lit(kind).alias("k"), text.alias("t"))
    strong = of.where(lone).select("node", "rank", key("word", F.col("words")[0]).alias("key"), F.lit(True).alias("strong"))
    two = of.where(~lone).select("node", "rank", "note", scope, F.explode(pairs).alias("pair")).select("node", "rank", key("pair", F.col("pair")).alias("key"), F.lit(True).alias("strong"))
    weak = of.where(~lone).select("node", "rank", "note", scope, F.explode("words").alias("word")).select("node", "rank", key("word", F.col("word")).alias("key"), F.lit(False).alias("strong"))
    weak = weak.join(strong.select("key").distinct(), "key", "left_semi").select("node", "rank", "key", "strong")
    found = greedy_leaders(strong.union(two).union(weak), known.where("fixed").select("node"))
    return known.join(found, "node", "left").select(scope, name, weight, F.coalesce("leader_rank.n", name).alias("canon"))


def similar_groups(names: DataFrame, name: str, order: str, least: float = ALIKE) -> DataFrame:
    """name, label: names by ``order``, each in the first group whose label is the same
    but for case and separators, or has the same note and bigrams alike by ``least``;
    a group's label is its longest name so far (then the last by alphabet).

    As labels change, groups are not decided by leaders: names that can ever meet are
    linked first (a prefix filter on rare bigrams), and each linked set runs past in
    order, compared with its own groups' labels only. The set's names are held until
    its labels are final."""
    known = stored(names.groupBy(F.col(name).alias("name")).agg(F.min(order).alias("order")).withColumns({"key": T.identity_key(F.col("name")), "note": T.note(F.col("name")), "grams": T.bigrams(F.col("name"))}))
    alike = resolve.similar_pairs(known, "name", least - 1e-9).select("a", "b")
    hubs = known.groupBy("key").agg(F.min("name").alias("a"))
    same = known.join(hubs, "key").where(F.col("name") != F.col("a")).select("a", F.col("name").alias("b"))
    scope = resolve.scopes(alike.union(same).withColumn("score", F.lit(1.0)), known)
    rows = known.join(scope, "name").select("scope", "order", "name", "key", "note", "grams")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, groups, member = None, [], []

        def closed() -> pa.RecordBatch:
            done, labels = [n for n, _ in member], [groups[g][0] for _, g in member]
            return pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(labels, pa.string())], names=["name", "label"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["scope"] != current:
                    yield closed()
                    current, groups, member = row["scope"], [], []
                grams = set(row["grams"])

                def fits(group) -> bool:
                    label, key, note, held = group
                    both = len(grams) + len(held)
                    return row["key"] == key or (row["note"] == note and both > 0 and 2.0 * len(grams & held) / both >= least)

                at = next((i for i, g in enumerate(groups) if fits(g)), None)
                own = [row["name"], row["key"], row["note"], grams]
                if at is None:
                    at = len(groups)
                    groups.append(own)
                elif (len(own[0]), own[0]) > (len(groups[at][0]), groups[at][0]):
                    groups[at] = own
                member.append((row["name"], at))
        yield closed()

    return rows.repartition("scope").sortWithinPartitions("scope", "order", "name").mapInArrow(fold, "name string, label string")


def grams_of(text: Column, n: int = GRAM) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(inner: DataFrame, outer: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, inner, outer: distinct texts (column text, GRAM letters at least) of which
    the first lies inside the second, within equal keys. Whatever holds a text holds its
    rarest gram: only texts that share that one meet and are compared."""
    held = outer.select(*keys, F.col("text").alias("outer"), F.explode(grams_of(F.col("text"))).alias("gram"))
    common = held.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("df"))
    asked = inner.select(*keys, F.col("text").alias("inner"), F.explode(grams_of(F.col("text"))).alias("gram")).join(common, [*keys, "gram"], "left")
    rarest = asked.groupBy(*keys, "inner").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).where("r.df > 0").select(*keys, "inner", "r.gram")
    return rarest.join(held, [*keys, "gram"]).where(F.contains("outer", "inner")).select(*keys, "inner", "outer")


def evidence(asked: DataFrame, name: str, rows: DataFrame, row: str, keys: list[Column], within: str | None = None) -> DataFrame:
    """name, row, how: the rows that a name means. By any of a row's keys, folded
    (exact); else without spaces (joined); else where one lies inside the other, both
    of GRAM letters at least (inside). Each later way is for names without a hit.
    within: a column of both sides whose values must agree; the result then has it."""
    scope = F.col(within) if within else F.lit(0)
    of = rows.select(scope.alias("of"), F.col(row).alias("row"), F.explode(F.array_distinct(F.array(*(T.fold(k) for k in keys)))).alias("key")).where("key <> ''")
    index = stored(of.withColumn("joined", F.replace("key", F.lit(" "), F.lit(""))))
    names = asked.select(scope.alias("of"), F.col(name).alias("name"), T.fold(F.col(name)).alias("key")).distinct().where("key <> ''").withColumn("joined", F.replace("key", F.lit(" "), F.lit("")))
    hit = lambda found, by: stored(found.join(index.select("of", by, "row"), ["of", by]).select("of", "name", "row").distinct())
    exact = hit(names, "key")
    rest = stored(names.join(exact.select("of", "name").distinct(), ["of", "name"], "left_anti"))
    joined = hit(rest, "joined")
    last = stored(rest.join(joined.select("of", "name").distinct(), ["of", "name"], "left_anti").where(F.length("joined") >= GRAM))
    keyed = stored(index.where(F.length("joined") >= GRAM).select("of", F.col("joined").alias("text")).distinct())
    left = last.select("of", F.col("joined").alias("text")).distinct()
    inner = contained(left, keyed, ("of",)).select("of", F.col("inner").alias("said"), F.col("outer").alias("joined"))
    outer = contained(keyed, left, ("of",)).select("of", F.col("outer").alias("said"), F.col("inner").alias("joined"))
    inside = hit(last.select("of", "name", F.col("joined").alias("said")).join(inner.union(outer).distinct(), ["of", "said"]), "joined")
    out = [F.col("of").alias(within)] if within else []
    named = lambda frame, how: frame.select(*out, F.col("name").alias(name), F.col("row").alias(row), F.lit(how).alias("how"))
    return named(exact, "exact").union(named(joined, "joined")).union(named(inside, "inside"))


def series(groups: DataFrame, aliases: DataFrame) -> DataFrame:
    """series, label, names, persons (of a team), mm: groups of one series as one.

    groups: name, who, mm; aliases: alias, canon from earlier answers, chains followed
    to their ends. Names whose representatives are the same but for case and separators
    are one series; its label is the words that all its names begin with and ' series',
    or its longest name where they share none. What all sorted lists begin with is what
    the first and the last of them do, so the label is an aggregate."""
    flat = resolve.close_aliases(aliases)
    placed = groups.join(flat.select(F.col("alias").alias("name"), F.col("canon").alias("rep")), "name", "left").withColumn("rep", F.coalesce("rep", "name"))
    words = F.split(F.trim(F.regexp_replace("name", r"\s+", " ")), " ")
    parts = placed.withColumns({"key": T.identity_key(F.col("rep")), "folded": F.transform(words, T.fold)})
    longest = F.min(F.struct((-F.length("name")).alias("n"), "name"))["name"]
    sums = parts.groupBy(F.col("key").alias("series")).agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.min("name").alias("first"), F.min("folded").alias("low"), F.max("folded").alias("high"), longest.alias("longest"), F.count_distinct("who").alias("persons"), F.round(F.sum("mm"), 3).alias("mm")
    )
    same = F.aggregate(F.arrays_zip("low", "high"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct((acc["n"] + F.when(acc["on"] & (x["low"] == x["high"]), 1).otherwise(0)).alias("n"), F.coalesce(acc["on"] & (x["low"] == x["high"]), F.lit(False)).alias("on")), lambda acc: acc["n"])
    stem = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("first", r"\s+", " ")), " "), F.lit(1), F.col("common")), " ")
    label = F.when(F.size("names") < 2, F.col("first")).when(F.col("common") > 0, F.concat(stem, F.lit(" series"))).otherwise(F.col("longest"))
    return sums.withColumn("common", same).select("series", label.alias("label"), "names", "persons", "mm")
