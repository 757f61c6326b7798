"""The registered queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontam, html_extract, language_id, lm_scoring, near_dup, packing, prefix_trie, sharding, token_store, topk_search, toxicity, url_filter
from .common import shared_dir, table

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    rows = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", F.round("log10_mean", 6).alias("log10_mean"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import atexit
    import uuid

    from .common import _drop_quietly

    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    token_store.write_store(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=2, width=2, drops_space=True)
    return token_store.indexed_digests(spark, path, docs.select("doc_id"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256.0, seed="2:")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("at", "subtree_end")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_topk_search": op2_topk_search,
    "op3_html_extract": op3_html_extract,
    "op4_packing": op4_packing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sharding": op6_sharding,
    "op7_near_dup": op7_near_dup,
    "op8_token_store": op8_token_store,
    "op9_url_filter": op9_url_filter,
    "op10_decontamination": op10_decontamination,
    "op11_centroids": op11_centroids,
    "op12_toxicity": op12_toxicity,
    "op13_prefix_trie": op13_prefix_trie,
}


def _claimed(names: list[str], size: int) -> str:
    """The lookup table as a list literal, made without the operator's code: claims in rounds of one for each shard."""
    starts = [int(sha256(x.encode()).hexdigest()[:16], 16) % size for x in names]
    steps = [int(sha256(x.encode()).hexdigest()[16:32], 16) % (size - 1) + 1 for x in names]
    owner: dict[int, int] = {}
    while len(owner) < size:
        for shard in range(min(len(names), size - len(owner))):
            while starts[shard] in owner:
                starts[shard] = (starts[shard] + steps[shard]) % size
            owner[starts[shard]] = shard
    return "[" + ",".join(str(owner[slot]) for slot in range(size)) + "]"


def _lloyd_sql(k: int, rounds: int, dim: int) -> str:
    """Every round spelled out: distances to all centroids, the nearest, floors of the means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (
          SELECT r, (min({{'d': d, 'c': c}})).c AS c, min(d) AS d
          FROM (SELECT v.r, c{i}.c, CAST(list_sum(list_transform(list_zip(v.e, c{i}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i})
          GROUP BY r)""")
        if i < rounds:
            means = ", ".join(f"CAST(sum(e[{j}]) // count(*) - CASE WHEN sum(e[{j}]) < 0 AND sum(e[{j}]) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT)" for j in range(1, dim + 1))
            steps.append(f"""
        m{i} AS (SELECT a{i}.c, [{means}] AS e FROM a{i} JOIN v USING (r) GROUP BY a{i}.c),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""
        WITH v AS MATERIALIZED (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
          SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), e) - 1 AS INTEGER) AS c, e
          FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k}),{",".join(steps)}
        SELECT v.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} ON a.c = c{rounds}.c
    """


def _crc32(digits: str) -> str:
    """The unsigned CRC-32 of a text of ASCII, bit by bit."""
    step = "list_reduce(list_concat([xor(c, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    codes = f"list_transform(string_split({digits}, ''), lambda d: CAST(ord(d) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: {step}), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op13_prefix_trie": f"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT conv_id, turn, length(text) AS n_chars, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)[1:32] AS t FROM t),
        o AS (SELECT conv_id, t, n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS pos FROM k),
        c AS (SELECT conv_id, conv_id - conv_id % 100 AS head, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM k)),
        g AS (SELECT c.*, least(h, (SELECT count(*) FROM o WHERE o.conv_id = c.head)) AS given FROM c),
        r AS (
          SELECT g.conv_id, o.pos, o.t, o.n_chars FROM g JOIN o ON o.conv_id = g.head AND o.pos <= g.h
          UNION ALL
          SELECT g.conv_id, o.pos - g.h + g.given, o.t, o.n_chars FROM g JOIN o ON o.conv_id = g.conv_id AND o.pos > g.h),
        p AS (
          SELECT conv_id, pos AS depth, n_chars, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
          UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        n AS (SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(n_chars) AS n_chars, count(*) AS n_convs FROM p GROUP BY path),
        kids AS (SELECT path[:-33] AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
        above AS (SELECT path, n_convs, n_chars, unnest(list_transform(range(CAST(depth + 1 AS BIGINT)), lambda d: left(path, 32 * d))) AS top FROM n),
        sums AS (
          SELECT top, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((n_convs - 1) * n_chars) AS saved
          FROM above LEFT JOIN kids USING (path) GROUP BY top),
        ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, sums.n_leaves,
               CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
        FROM n JOIN sums ON sums.top = n.path LEFT JOIN kids ON kids.path = n.path LEFT JOIN ends ON ends.path = n.path
        LEFT JOIN n parent ON n.depth > 0 AND parent.path = n.path[:-33]
    """,
    "op11_centroids": _lloyd_sql(40, 5, 64),
    "op6_sharding": f"""
        WITH t AS (SELECT {_claimed(SHARDS, sharding.TABLE_SIZE)} AS owners),
        d AS (SELECT doc_id, CAST(CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), chr(0)))[1:8] AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents),
        s AS (SELECT unnest(range({sharding.TABLE_SIZE})) AS slot, unnest(owners) AS shard FROM t)
        SELECT d.doc_id, d.slot, CAST(s.shard AS INTEGER) AS shard FROM d JOIN s ON s.slot = d.slot
    """,
    "op5_lm_scoring": """
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
          FROM documents),
        t AS (SELECT r, generate_subscripts(w, 1) AS p, unnest(w) AS c FROM d WHERE len(w) > 0),
        g AS (SELECT r, p, c, lag(c) OVER q AS b, lag(c, 2) OVER q AS a FROM t WINDOW q AS (PARTITION BY r ORDER BY p)),
        o1 AS (SELECT r, c, count(*) AS n FROM g GROUP BY ALL),
        o2 AS (SELECT r, b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL),
        o3 AS (SELECT r, a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY ALL),
        c1 AS (SELECT c, sum(n) AS n FROM o1 GROUP BY ALL),
        c2 AS (SELECT b, c, sum(n) AS n FROM o2 GROUP BY ALL),
        c3 AS (SELECT a, b, c, sum(n) AS n FROM o3 GROUP BY ALL),
        l AS (SELECT r, count(*) AS n FROM t GROUP BY r),
        x1 AS (SELECT o1.r, o1.c, c1.n - o1.n AS n FROM o1 JOIN c1 USING (c)),
        x2 AS (SELECT o2.r, o2.b, o2.c, c2.n - o2.n AS n FROM o2 JOIN c2 USING (b, c)),
        x3 AS (SELECT o3.r, o3.a, o3.b, o3.c, c3.n - o3.n AS n FROM o3 JOIN c3 USING (a, b, c)),
        s AS (
          SELECT g.r, CASE
            WHEN x3.n > 0 THEN log10(x3.n / y2.n)
            WHEN x2.n > 0 THEN log10(x2.n / y1.n) + CASE WHEN g.a IS NULL THEN 0 ELSE log10(0.4) END
            ELSE CASE WHEN x1.n > 0 THEN log10(x1.n / ((SELECT count(*) FROM t) - l.n)) ELSE -log10((SELECT count(*) FROM t)) END
                 + (CASE WHEN g.b IS NULL THEN 0 ELSE 1 END + CASE WHEN g.a IS NULL THEN 0 ELSE 1 END) * log10(0.4) END AS v
          FROM g JOIN l ON g.r = l.r
          JOIN x1 ON x1.r = g.r AND x1.c = g.c
          LEFT JOIN x1 y1 ON y1.r = g.r AND y1.c = g.b
          LEFT JOIN x2 ON x2.r = g.r AND x2.b = g.b AND x2.c = g.c
          LEFT JOIN x2 y2 ON y2.r = g.r AND y2.b = g.a AND y2.c = g.b
          LEFT JOIN x3 ON x3.r = g.r AND x3.a = g.a AND x3.b = g.b AND x3.c = g.c)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_tokens, round(m.v, 6) AS log10_mean
        FROM d LEFT JOIN (SELECT r, avg(v) AS v FROM s GROUP BY r) m ON d.r = m.r
    """,
    "op2_topk_search": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM (SELECT DISTINCT ON (vec_id) vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
