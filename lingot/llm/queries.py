"""The operators as queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .bag_minhash import near_duplicates
from .filter_audit import filter_audit
from .kd_sharding import kd_shards
from .mixing import mix
from .packing import pack
from .quality import quality
from .secret_scan import secrets
from .shared import table
from .substring_dedup import without_repeats
from .token_counts import token_counts
from .toxicity import toxicity
from .vector_dedup import near_vectors
from .whitening import whiten


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), n_shards=24)


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("predicted") == 1)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, its source for the owner."""
    return secrets(table(spark, sf_dir, "documents"), owner=F.col("source"), repository=F.col("doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_adaptive_scan, op2_curriculum_mix, op3_metric_range_join, op4_weak_toxicity, op5_seed_and_extend, op6_kd_shards, op7_bag_minhash, op8_weak_quality, op9_token_counts, op10_pattern_packing, op11_qdwh_whitening, op12_filter_audit, op13_secret_owners)
}

_WORDS = r"words AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents))"
_REACH = "reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a), components AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)"

#: Queries that depend on hashes, tokenizers or training have no SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_metric_range_join": f"""WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        nodes AS (SELECT DISTINCT a AS node FROM pairs), {_REACH}, degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN degree ON a = vec_id LEFT JOIN components ON node = vec_id""",
    "op5_seed_and_extend": f"""WITH {_WORDS}, w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS span FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM w WHERE len(w) >= 20)),
        again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY span ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest(range(20)) AS k)),
        told AS (SELECT doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS left_over FROM words w LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM documents LEFT JOIN told USING (doc_id)""".replace("USING (doc_id, i) GROUP BY doc_id", "ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id").replace("told AS (SELECT doc_id,", "told AS (SELECT w.doc_id AS doc_id,"),
    "op7_bag_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingles AS (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)) GROUP BY ALL),
        sizes AS (SELECT doc_id, sum(c) AS n FROM shingles GROUP BY doc_id),
        overlaps2 AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        pairs AS (SELECT a, b FROM overlaps2 JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE common >= 0.8 * (p.n + q.n - common)),
        nodes AS (SELECT DISTINCT a AS node FROM pairs), {_REACH}
        SELECT doc_id, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN components ON node = doc_id""",
    "op12_filter_audit": """WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
        said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
            || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
            || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN said USING (doc_id)),
        sums AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        steps AS (SELECT filter_order, k::INT AS step, substr(filter_order, k, 1) AS own, substr(filter_order, 1, k - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
        told AS (SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS has, translate(fails, before, '') <> fails AS gone FROM steps, sums),
        rows AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT has AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN has AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
            sum(CASE WHEN has AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
            sum(CASE WHEN has AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN has AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM told GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM rows""",
}
