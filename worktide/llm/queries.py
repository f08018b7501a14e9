"""The registered queries of the subpackage: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from worktide.llm import bpe_codec, decontaminate, fingerprints, merkle_manifest, ngram_join, periodic_runs, source_mix, substring_dedup, token_counts, token_shards, toxicity, url_rules, voronoi_knn
from worktide.llm._common import WORD, shared_dir, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer_path())
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


TOXIC = 0.7


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """The classifier of op2 and the pipeline: the labelled rows outside the
    held-out third teach it."""
    taught = labels.where(~held_out("doc_id")).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(docs, taught)


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit_toxicity(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))
    digest = lambda column: F.sha2(F.col(column).cast("string"), 256)
    return printed.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), digest("marks").alias("fingerprint"), digest("edited_marks").alias("edited_fingerprint"), "near_edited", "near_next"
    )


def op4_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = source_mix.weighted_fair_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.decode(bpe_codec.encode(docs, tokenizer_path()).drop("text"), tokenizer_path())
    return coded.select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ordered, _ = token_shards.training_order(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return token_shards.write_shards(ordered, shared_dir(spark))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, a tenth of them (by crc32 of doc_id) repeating a
    stretch of their words from some word on."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))
    words = F.filter(F.split("text", WORD.replace("[^", "[")), lambda w: w != "")
    # exploding an array of one splits each text once; a plain column would be put in again wherever it is used
    picked = docs.select("doc_id", "text", h.alias("h"), F.explode(F.array(F.when(h % 10 == 0, words))).alias("words"))
    n, m = F.size("words"), F.col("n") - F.col("a")
    start = picked.withColumn("n", n).withColumns({"a": F.expr("if(n > 0, cast((h div 10) % n as int), 0)"), "k": F.expr("cast(3 + (h div 10) % 8 as int)")})
    placed = start.withColumn("p", F.expr("1 + (n - a) div k").cast("int"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil(m / F.col("p")).cast("int"))), F.lit(1), m)
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    better = lambda a, b: F.when((b["length"] * a["period"] > a["length"] * b["period"]) | a["length"].isNull(), b).otherwise(a)
    nothing = F.expr("cast(null as struct<start: long, length: long, period: long>)")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    best = found.withColumn("best", F.aggregate("runs", nothing, better))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle_manifest.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("node"), F.when(tampered, leaf(F.translate("text", CAPITALS, SMALL))).alias("changed"))
    proofs = merkle_manifest.manifest(leaves, "source", "doc_id", "node", ["doc_id", "changed"])
    folded = merkle_manifest.folded(F.coalesce("changed", "node"), F.col("path")).alias("folded_root")
    proof = F.sha2(F.encode(merkle_manifest.joined(F.col("path")), "UTF-8"), 256).alias("proof_sha256")
    return proofs.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof, folded).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_voronoi_knn": op4_voronoi_knn,
    "op5_source_mix": op5_source_mix,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_rules": op7_url_rules,
    "op8_ngram_join": op8_ngram_join,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_token_shards": op10_token_shards,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_decontaminate": op12_decontaminate,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op4_voronoi_knn": """
        WITH valid AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), scored AS (
            SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
            FROM valid q JOIN valid d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op7_url_rules": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), rules(rhost, rpath, verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), fits AS (
            SELECT p.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
            FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
            GROUP BY p.page_id
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)
    """,
}

#: crc32 of a decimal number as SQL: a table of 256 remainders, then a byte at a time.
_CRC = """crc_table AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        )"""
_CRC_OF_ID = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _levels(source: str, name: str) -> str:
    """A recursive table of all levels of the trees over ``source`` (tree, i, h, n)."""
    return f"""{name}(lvl, tree, i, h, n) AS (
            SELECT 0, tree, i, h, n FROM {source}
            UNION ALL
            SELECT lvl + 1, tree, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY lvl, tree, i // 16, n
        )"""


def _steps(source: str, levels: str, name: str) -> str:
    """tree, i of each node of ``source`` and its siblings left and right by level."""
    return f"""{name} AS (
            SELECT tree, i, list({{'l': l, 'r': r}} ORDER BY lvl) AS path FROM (
                SELECT a.tree, a.i, b.lvl, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i // (16 ** b.lvl)::BIGINT), '') AS l,
                       coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i // (16 ** b.lvl)::BIGINT), '') AS r
                FROM {source} a JOIN {levels} b ON b.tree = a.tree AND b.n > 1 AND b.i // 16 = a.i // (16 ** (b.lvl + 1))::BIGINT
                GROUP BY a.tree, a.i, b.lvl
            ) GROUP BY tree, i
        )"""


ORACLE_SQL |= {
    "op12_decontaminate": r"""
        WITH item AS (
            SELECT row_number() OVER () AS no, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
        ), doc AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
        ), place AS (
            SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc JOIN (SELECT DISTINCT n FROM win) ON len(w) >= n)
        ), hit AS (SELECT r, i, n, item_id FROM place JOIN win USING (n, k)
        ), word AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r
        ), name AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR) FILTER (item_id IS NOT NULL)) AS ids FROM hit GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
               sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN word USING (r) LEFT JOIN name USING (r)
    """,
    "op13_merkle_manifest": f"""
        WITH RECURSIVE {_CRC}, part AS (
            SELECT doc_id, coalesce('=' || source, '') AS tree, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
                   CASE WHEN coalesce({_CRC_OF_ID} % 5 = 0, false) THEN translate(text, '{CAPITALS}', '{SMALL}') ELSE text END AS forged
            FROM documents, crc_table
        ), hashed AS (
            SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, sha256(head || coalesce(strlen(forged) || ':' || forged, '-')) AS f FROM part
        ), leaf AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM hashed
        ), {_levels('leaf', 'node')}, {_steps('leaf', 'node', 'inner_path')}, top AS (
            SELECT '' AS tree, tree AS of_tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1
        ), {_levels('top', 'above')}, {_steps('top', 'above', 'upper_path')}, whole AS (
            SELECT leaf.doc_id, leaf.h, leaf.f, top.h AS subroot, (SELECT h FROM above WHERE n = 1) AS root, list_concat(coalesce(p.path, []), coalesce(u.path, [])) AS path
            FROM leaf JOIN top ON top.of_tree = leaf.tree LEFT JOIN inner_path p ON p.tree = leaf.tree AND p.i = leaf.i LEFT JOIN upper_path u ON u.i = top.i
        ), done AS (
            SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
                   list_reduce(list_prepend({{'l': '', 'r': f}}, path), lambda a, s: {{'l': '', 'r': sha256(s.l || a.r || s.r)}}).r AS folded_root
            FROM whole
        )
        SELECT *, folded_root = root AS verified FROM done
    """,
}
