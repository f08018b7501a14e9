"""URL rules by a sort-merge range join.

A host read from its last label, each label closed by "/", is its canonical key
(www.example.com -> com/example/www/; no host contains "/"). The subdomains of a
rule's host are then exactly the keys that begin with the rule's key: an
interval. Urls and rules are cut at the same points of the key order, bounded in
number and drawn from a bounded sample of urls; a rule goes to every part that
its interval meets, and a hash behind the key lets a cut fall inside a host that
very many urls share. Each part is sorted and swept once: a stack holds the rules
whose intervals are open, the innermost on top, and a url looks for the longest
rule on the stack whose path its own path begins with. Rules are data: any number
of them, never broadcast.

A url's host is what follows the first "://" up to "/", "?" or "#", with A-Z
lower-cased; its path follows up to "?" or "#". Null urls and urls without "://"
have neither and fit no rule. A url that no rule fits gets rule null and the
default verdict, allow: the rules only name exceptions. Of rules for one host and
path, block wins; rules with a null host or path, or an empty host, are left out.
Of fitting rules the longest (host and path together, then host) wins. Repeated
rows are judged alike; extra columns pass through, those named as results are
replaced. No rows give no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from worktide.llm._common import in_small_batches, n_partitions

DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PER_PART, KEY_CHARS = 64, 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def cuts(urls: DataFrame, parts: int) -> list[tuple[str, int]]:
    """At most parts - 1 points of the (key, salt) order, from a sample by hash
    of about 2 * parts * PER_PART urls, however many there are."""
    step = max(1, urls.count() // (2 * parts * PER_PART))
    drawn = urls.where(F.pmod("salt", F.lit(step)) == 0).select(F.substring("key", 1, KEY_CHARS).alias("key"), "salt").collect()
    order = sorted((r["key"], r["salt"]) for r in drawn)
    return sorted({order[len(order) * i // parts] for i in range(1, parts)}) if order else []


def in_parts(frame: DataFrame, points: list[tuple[str, int]], interval: bool) -> DataFrame:
    """``frame`` with the part of each row; a rule once for each part it meets."""
    schema = T.StructType([*frame.schema.fields, T.StructField("part", T.IntegerType())])
    least, most = -(1 << 63), 1 << 63

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, part = batch["key"].to_pylist(), [], []
            salts = [None] * len(keys) if interval else batch["salt"].to_pylist()
            for i, (key, salt) in enumerate(zip(keys, salts)):
                if interval:
                    first, last = bisect.bisect_right(points, (key, least)), bisect.bisect_right(points, (key + "\U0010ffff", most))
                    rows += [i] * (last - first + 1)
                    part += range(first, last + 1)
                else:
                    rows.append(i)
                    part.append(bisect.bisect_right(points, (key, salt)))
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part, pa.int32())], names=[*taken.schema.names, "part"])

    return frame.mapInArrow(deal, schema)


class Open:
    """The open rules of one host: path -> (verdict, name)."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if self.paths.get(path) != "block":
            self.paths[path] = verdict
        at = bisect.bisect_left(self.lengths, len(path))
        if self.lengths[at : at + 1] != [len(path)]:
            self.lengths.insert(at, len(path))

    def longest(self, path: str) -> str | None:
        known = self.lengths[: bisect.bisect_right(self.lengths, len(path))]
        return next((path[:n] for n in reversed(known) if path[:n] in self.paths), None)


def sweep(both: DataFrame, default: str) -> DataFrame:
    """Judge the urls of sorted parts; rules come before urls of the same key."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, part = [], None
        for batch in batches:
            keep, rules, verdicts = [], [], []
            rows = zip(*(batch[c].to_pylist() for c in ("part", "key", "is_url", "host", "path", "verdict")))
            for i, (own, key, is_url, host, path, verdict) in enumerate(rows):
                if own != part:
                    stack, part = [], own
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1].key != key:
                        stack.append(Open(key, host))
                    stack[-1].add(path, verdict)
                    continue
                best = None
                for level in stack:
                    if (fit := level.longest(path)) is not None and (best is None or len(level.host) + len(fit) >= len(best[0]) + len(best[1])):
                        best = (level.host, fit, level.paths[fit])
                keep.append(i)
                rules.append(best and best[0] + best[1])
                verdicts.append(best[2] if best else default)
            out = batch.select(["row", "host", "path"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["row", "host", "path", "rule", "verdict"])

    fields = {f.name: f for f in both.schema.fields}
    text = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    return both.mapInArrow(judge, T.StructType([fields["row"], *text]))


def told_apart(pages: DataFrame, names: list[str]) -> list[Column]:
    """What tells rows apart, as columns that have a hash: maps have none."""
    nested = ("map", "array", "struct", "variant")
    value = lambda c: F.to_json(F.struct(F.col(f"row.`{c}`"))) if pages.schema[c].dataType.typeName() in nested else F.col(f"row.`{c}`")
    return [value(c) for c in names]


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict; rules: host, path, verdict."""
    result = ("host", "path", "rule", "verdict")
    own = [c for c in pages.columns if c.lower() not in result]
    host, path = host_and_path(F.col(url))
    parts = 4 * n_partitions(pages.sparkSession)
    urls = in_small_batches(pages).select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), host.alias("host"), path.alias("path")).withColumns({"key": canonical(F.col("host")), "salt": F.xxhash64("path", *told_apart(pages, own))})
    points = cuts(urls, parts)
    named = rules.where("host <> '' and path is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").withColumn("key", canonical(F.col("host")))
    dealt = in_parts(urls, points, False).withColumns({"is_url": F.lit(True), "verdict": F.lit(None).cast("string")})
    ruled = in_parts(named, points, True).withColumns({"is_url": F.lit(False), "salt": F.lit(None).cast("long"), "row": F.lit(None).cast(urls.schema["row"].dataType)})
    both = dealt.unionByName(ruled).repartition(n_partitions(pages.sparkSession), "part").sortWithinPartitions("part", "key", "is_url")
    judged = sweep(both.drop("salt"), default)
    return judged.select(*(F.col("row").getField(c).alias(c) for c in own), *result)
