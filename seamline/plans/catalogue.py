"""Every operator as a query over the driver's tables, with the SQL that says the same.

Sequences are users (events in order of time), conversations (turns), embeddings of one label (by id) and documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..functions.vectors import dissimilarity
from ..operators import evaluate as E
from ..operators import folds, sequences, signals
from ..operators import temporal_joins as J
from ..operators.keys import with_settings
from ..operators.embedding import embed
from ..sources import audio, scratch, sinks, transcripts
from . import experiments, plots, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- inputs in the library's shape

def _events(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6D")
    return _table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", seconds.alias("t"))


def _of(spark: SparkSession, sf: str, kind: str, index: str, *more: str) -> DataFrame:
    """user_id, time, index of one type's events, numbered in order of time."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = _events(spark, sf).where(F.col("event_type") == kind)
    return rows.select("user_id", F.col("t").alias("time"), (F.row_number().over(w) - 1).cast("int").alias(index), *more)


def _dips(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).where("event_type = 'click'")
    return rows.select("user_id", F.col("event_id").alias("boundary_index"), F.col("t").alias("boundary_time"), F.col("value").alias("similarity"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select(F.col("label").alias("lecture_id"), F.col("vec_id").alias("window_id"), F.col("vec_id").cast("double").alias("start"), (F.col("vec_id") + 1).cast("double").alias("end"), "embedding")
    return signals.adjacent_similarity(vectors).withColumn("similarity", F.round("similarity", 6))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "conversations").select(F.col("conv_id").alias("lecture_id"), F.col("turn").cast("int").alias("block_id"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text")


def _doc_cues(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("lecture_id"), F.lit(0).alias("block_id"), F.lit(0.0).alias("start"), F.col("n_chars").cast("double").alias("end"), "text")


#: A transcript made of events: what an event says is put together from an opening, which most classes are known by, and
#: an object, which most topics are known by. Both go round at different paces, so each meets each.
_OPENINGS = [
    "let's define what we mean by", "for example we take", "mathematically this is the same as", "keep in mind that we need", "good question: how do we read",
    "today we go on with", "suppose we have", "in practice people use", "the definition of", "why does it depend on", "okay, so", "about the deadline and", "another word on", "now let's move on to", "next up is",
]
_OBJECTS = [
    "a numpy array", "the pandas data frame", "artificial intelligence", "machine learning", "supervised data", "the loss function", "gradient descent", "a classifier", "linear regression",
    "a neural network", "the cnn layer", "max pooling", "relu units", "the roc curve", "feature engineering", "model training", "self-driving cars", "structural engineering", "software engineering",
    "your project", "commercialisation", "your question", "a plain example", "nothing of note", "um",
]


def _speech(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    text = F.concat_ws(" ", pick(_OPENINGS, F.col("event_id")), pick(_OBJECTS, F.floor(F.col("event_id") / 3)))
    return _events(spark, sf).select(F.col("user_id").alias("lecture_id"), F.col("event_id").alias("block_id"), (F.col("t") / 600).alias("start"), (F.col("t") / 600 + 5).alias("end"), text.alias("text"))


def _words_sql(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_SPEECH_SQL = f"{_words_sql(_OPENINGS)}[event_id % {len(_OPENINGS)} + 1] || ' ' || {_words_sql(_OBJECTS)}[event_id // 3 % {len(_OBJECTS)} + 1]"

_E = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events)"


def _of_sql(name: str, kind: str, index: str) -> str:
    return f"{name} AS (SELECT user_id, t AS time, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS INTEGER) AS {index} FROM e WHERE event_type = '{kind}')"


_PG = f"{_E}, {_of_sql('p', 'click', 'pred_index')}, {_of_sql('g', 'purchase', 'gt_index')}"
_EDGES = """v AS (SELECT label AS lecture_id, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    n AS (SELECT *, lead(vec_id) OVER w AS next_id, lead(x) OVER w AS y FROM v WINDOW w AS (PARTITION BY lecture_id ORDER BY vec_id)),
    edges AS (SELECT lecture_id, vec_id AS left_window_id, next_id AS right_window_id,
      round(CASE WHEN list_dot_product(x, x) = 0 OR list_dot_product(y, y) = 0 THEN 0 ELSE list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) END, 6) AS similarity
      FROM n WHERE next_id IS NOT NULL)"""


def _greedy_sql(preds: str, truths: str, key: str, tolerance: float | str, out: str = "m") -> str:
    """CTEs (after WITH RECURSIVE) whose last, ``out``, has the matches of preds (key, time, pred_index) and truths."""
    return f"""
    {out}_s AS (SELECT {key} AS k, list({{'i': gt_index, 't': time}} ORDER BY gt_index) AS gl FROM {truths} GROUP BY {key}),
    {out}_r(k, i, used, gi) AS (
      SELECT k, -1, CAST([] AS INTEGER[]), CAST(NULL AS INTEGER) FROM {out}_s
      UNION ALL
      SELECT k, i, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.i) END, b.i FROM (
        SELECT r.k, p.pred_index AS i, r.used,
          list_sort(list_transform(list_filter(s.gl, lambda q: abs(q.t - p.time) <= {tolerance} AND NOT list_contains(r.used, q.i)), lambda q: {{'d': abs(q.t - p.time), 'i': q.i}}))[1] AS b
        FROM {out}_r r JOIN {preds} p ON p.{key} = r.k AND p.pred_index = r.i + 1 JOIN {out}_s s ON s.k = r.k)),
    {out} AS (
      SELECT r.k AS {key}, r.gi AS gt_index, g.time AS gt_time, r.i AS pred_index, p.time AS pred_time, abs(p.time - g.time) AS abs_error_sec
      FROM {out}_r r JOIN {truths} g ON g.{key} = r.k AND g.gt_index = r.gi JOIN {preds} p ON p.{key} = r.k AND p.pred_index = r.i WHERE r.gi IS NOT NULL)"""


def _prf_sql(match: str, preds: str, truths: str, key: str, out: str = "f") -> str:
    return f"""
    {out}_c AS (SELECT k.{key}, coalesce(p.n, 0) AS pred_count, k.n AS gt_count, coalesce(m.n, 0) AS tp
      FROM (SELECT {key}, count(*) AS n FROM {truths} GROUP BY {key}) k
      LEFT JOIN (SELECT {key}, count(*) AS n FROM {preds} GROUP BY {key}) p ON p.{key} = k.{key}
      LEFT JOIN (SELECT {key}, count(*) AS n FROM {match} GROUP BY {key}) m ON m.{key} = k.{key}),
    {out}_pr AS (SELECT *, CASE WHEN pred_count > 0 THEN tp / pred_count ELSE 0.0 END AS precision, CASE WHEN gt_count > 0 THEN tp / gt_count ELSE 0.0 END AS recall FROM {out}_c),
    {out} AS (SELECT {key}, pred_count, gt_count, tp, pred_count - tp AS fp, gt_count - tp AS fn, precision, recall,
      CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM {out}_pr)"""


TOL = 21600.0  # seconds; events of a user lie hours apart
_PREDS_TRUTHS_MATCH = f"{_PG}, {_greedy_sql('p', 'g', 'user_id', TOL)}"


def _preds(spark: SparkSession, sf: str) -> DataFrame:
    return _of(spark, sf, "click", "pred_index")


def _truths(spark: SparkSession, sf: str) -> DataFrame:
    return _of(spark, sf, "purchase", "gt_index")


# ---- text and windows

_UNITS = r"""
    s AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS dur, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents),
    q AS (SELECT doc_id, dur, unnest(parts) AS text, generate_subscripts(parts, 1) AS i, len(parts) AS n, list_sum(list_transform(parts, lambda x: length(x))) AS total FROM s),
    units AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_id,
      coalesce(sum(dur * (length(text) / total)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
      CASE WHEN i = n THEN dur ELSE sum(dur * (length(text) / total)) OVER (PARTITION BY doc_id ORDER BY i) END AS end_, text FROM q)"""


@_query(f"WITH {_UNITS} SELECT doc_id, sentence_id, round(start + 1e-7, 3) AS start, round(end_ + 1e-7, 3) AS \"end\", text FROM units")
def sentence_units(spark, sf):
    return sequences.sentence_units(_doc_cues(spark, sf)).select(F.col("lecture_id").alias("doc_id"), "sentence_id", F.round(F.col("start") + 1e-7, 3).alias("start"), F.round(F.col("end") + 1e-7, 3).alias("end"), "text")


@_query(f"""
    WITH RECURSIVE {_UNITS},
    r AS (
      SELECT doc_id, sentence_id, text AS held, start AS hs, end_ AS he FROM units WHERE sentence_id = 0
      UNION ALL
      SELECT u.doc_id, u.sentence_id, CASE WHEN length(r.held) >= 25 THEN u.text ELSE r.held || ' ' || u.text END, CASE WHEN length(r.held) >= 25 THEN u.start ELSE r.hs END, u.end_
      FROM r JOIN units u ON u.doc_id = r.doc_id AND u.sentence_id = r.sentence_id + 1),
    l AS (SELECT *, lead(sentence_id) OVER (PARTITION BY doc_id ORDER BY sentence_id) IS NULL AS last FROM r)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id) - 1 AS INTEGER) AS sentence_id, round(hs + 1e-7, 3) AS start, round(he + 1e-7, 3) AS "end", held AS text
    FROM l WHERE length(held) >= 25 OR last""")
def merge_short_sentences(spark, sf):
    units = sequences.merge_short(sequences.sentence_units(_doc_cues(spark, sf)))
    return units.select(F.col("lecture_id").alias("doc_id"), "sentence_id", F.round(F.col("start") + 1e-7, 3).alias("start"), F.round(F.col("end") + 1e-7, 3).alias("end"), "text")


@_query("""
    WITH w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS window_id, list(turn) OVER x AS ids, list(text) OVER x AS texts
      FROM conversations WINDOW x AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT conv_id, CAST(window_id AS INTEGER) AS window_id, CAST(ids[1] AS DOUBLE) AS start, CAST(ids[3] + 1 AS DOUBLE) AS "end", array_to_string(ids, ';') AS sentence_ids, array_to_string(texts, ' ') AS text FROM w WHERE len(ids) = 3""")
def sliding_windows(spark, sf):
    units = _turns(spark, sf).withColumnRenamed("block_id", "sentence_id")
    found = sequences.sliding_windows(units, 3)
    return found.select(F.col("lecture_id").alias("conv_id"), "window_id", "start", "end", F.array_join(F.transform("sentence_ids", lambda x: x.cast("string")), ";").alias("sentence_ids"), "text")


@_query(f"""
    WITH {_E}, c AS (SELECT user_id, event_id, t AS s, t + value * 60 AS f, event_type FROM e),
    b AS (SELECT user_id, arg_min(s, event_id) AS t0, arg_max(f, event_id) AS t1 FROM c GROUP BY user_id),
    w AS (SELECT user_id, t0, t1, unnest(generate_series(0, CAST(ceil((t1 - t0) / 86400.0) AS BIGINT) - 1)) AS k FROM b WHERE t1 > t0),
    h AS (SELECT w.user_id, k, t0 + k * 86400.0 AS ws, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM w JOIN c ON c.user_id = w.user_id AND c.f > t0 + k * 86400.0 AND c.s < t0 + k * 86400.0 + 86400.0 GROUP BY ALL)
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS INTEGER) AS window_id, ws AS start, ws + 86400.0 AS "end", text FROM h""")
def tumbling_time_windows(spark, sf):
    cues = _events(spark, sf).select(F.col("user_id").alias("lecture_id"), F.col("event_id").alias("block_id"), F.col("t").alias("start"), (F.col("t") + F.col("value") * 60).alias("end"), F.col("event_type").alias("text"))
    return sequences.tumbling_windows(cues, 86400.0).withColumnRenamed("lecture_id", "user_id")


@_query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('<v ' || role || '>' || text || ' [noise]', '\n', ' ', 'g'), '<[^>]+>', '', 'g'), '\[(.*?)\]', '', 'g'), '\s+', ' ', 'g')) AS text FROM conversations""")
def clean_text(spark, sf):
    marked = F.concat(F.lit("<v "), "role", F.lit(">"), "text", F.lit(" [noise]"))
    return _table(spark, sf, "conversations").select("conv_id", "turn", X.clean(marked).alias("text"))


@_query(f"""
    WITH {_E}, x AS (SELECT event_id, t - 1704067200 AS s FROM e), y AS (SELECT *, CAST(floor(s) AS BIGINT) AS a, CAST(round_even(s, 0) AS BIGINT) AS b FROM x)
    SELECT event_id, printf('%02d:%02d:%02d', a // 3600, a % 3600 // 60, a % 60) AS cut, printf('%02d:%02d:%02d', b // 3600, b % 3600 // 60, b % 60) AS near, CAST(a AS DOUBLE) AS back FROM y""")
def clock_formats(spark, sf):
    s = F.col("t") - 1704067200
    cut = X.hms_floor(s)
    return _events(spark, sf).select("event_id", cut.alias("cut"), X.hms_nearest(s).alias("near"), X.clock_seconds(cut).alias("back"))


# ---- similarity

@_query(f"WITH {_EDGES} SELECT lecture_id, left_window_id, right_window_id, similarity FROM edges")
def adjacent_similarity(spark, sf):
    return _edges(spark, sf).select("lecture_id", "left_window_id", "right_window_id", "similarity")


_DIPS = f"""{_EDGES},
    x AS (SELECT *, coalesce(similarity < lag(similarity) OVER w AND similarity < lead(similarity) OVER w, false) AS low,
      lag(similarity) OVER w AS sb, lead(similarity) OVER w AS sa FROM edges WINDOW w AS (PARTITION BY lecture_id ORDER BY left_window_id))"""


@_query(f"WITH {_DIPS} SELECT lecture_id, left_window_id, similarity FROM x WHERE low")
def local_minima(spark, sf):
    rows = _edges(spark, sf).withColumn("low", signals.local_minimum("similarity", "lecture_id", "left_window_id"))
    return rows.where("low").select("lecture_id", "left_window_id", "similarity")


def _rule_sql(rule: str, where: str, reason: str) -> str:
    return f"SELECT '{rule}' AS rule, lecture_id, CAST(row_number() OVER (PARTITION BY lecture_id ORDER BY right_window_id) - 1 AS INTEGER) AS boundary_index, CAST(right_window_id AS DOUBLE) AS boundary_time, similarity, '{reason}' AS reason FROM x WHERE {where}"


@_query(f"WITH {_DIPS} {_rule_sql('threshold', 'similarity < 0.05', 'low_similarity')} UNION ALL {_rule_sql('minimum', 'similarity < 0.05 AND low', 'low_similarity_and_local_minimum')}")
def boundary_rules(spark, sf):
    edges = _edges(spark, sf)
    parts = [signals.dips(edges, 0.05, r == "minimum").select(F.lit(r).alias("rule"), "lecture_id", "boundary_index", "boundary_time", "similarity", "reason") for r in ("threshold", "minimum")]
    return parts[0].unionByName(parts[1])


@_query(f"""
    WITH {_DIPS} SELECT lecture_id, CAST(row_number() OVER (PARTITION BY lecture_id ORDER BY right_window_id) - 1 AS INTEGER) AS boundary_index, CAST(right_window_id AS DOUBLE) AS boundary_time, similarity,
      round(coalesce(least(sb - similarity, sa - similarity), 0), 6) AS prominence FROM x WHERE low AND similarity < 0.2 AND coalesce(least(sb - similarity, sa - similarity), 0) >= 0.05 - 1e-12""")
def prominence_filter(spark, sf):
    return signals.dips(_edges(spark, sf), 0.2, True, 0.05).select("lecture_id", "boundary_index", "boundary_time", "similarity", "prominence")


@_query(f"WITH {_EDGES} SELECT * FROM (SELECT lecture_id, left_window_id, similarity, CAST(row_number() OVER (PARTITION BY lecture_id ORDER BY similarity, left_window_id) AS INTEGER) AS rank FROM edges) WHERE rank <= 5")
def candidate_topn(spark, sf):
    return experiments.top_candidates(_edges(spark, sf), 5).select("lecture_id", "left_window_id", "similarity", "rank")


# ---- folds

def _fold_sql(better: str) -> str:
    return f"""
    WITH RECURSIVE {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM e),
    r AS (
      SELECT user_id, rn, 1 AS kept, t AS lt, value AS lv, event_id AS li FROM o WHERE rn = 1
      UNION ALL
      SELECT o.user_id, o.rn, CASE WHEN o.t - r.lt >= 21600 THEN kept + 1 ELSE kept END,
        CASE WHEN o.t - r.lt >= 21600 OR {better} THEN o.t ELSE lt END, CASE WHEN o.t - r.lt >= 21600 OR {better} THEN o.value ELSE lv END, CASE WHEN o.t - r.lt >= 21600 OR {better} THEN o.event_id ELSE li END
      FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
    SELECT user_id, arg_max(lt, rn) AS time, arg_max(li, rn) AS event_id FROM r GROUP BY user_id, kept"""


@_query(_fold_sql("o.value < r.lv"))
def min_distance_strongest(spark, sf):
    rows = _events(spark, sf).select("user_id", F.col("t").alias("time"), "event_id", F.col("value").alias("similarity"))
    return folds.space_strongest(rows, 21600.0, "user_id", "time", "event_id").select("user_id", "time", "event_id")


@_query(_fold_sql("false"))
def min_distance_first(spark, sf):
    rows = _events(spark, sf).select("user_id", F.col("t").alias("time"), "event_id")
    return folds.space_first(rows, 21600.0, "user_id", "time", "event_id").select("user_id", "time", "event_id")


@_query(f"""
    WITH {_E}, x AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 10800 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    y AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS INTEGER) AS cluster FROM x)
    SELECT user_id, cluster, round(avg(t), 3) AS time, count(*) AS n FROM y GROUP BY ALL""")
def gap_clusters(spark, sf):
    rows = _events(spark, sf).select("user_id", F.col("t").alias("time"), F.col("event_id").alias("idx"))
    return folds.gap_clusters(rows, 10800.0, "user_id").withColumn("time", F.round("time", 3))


# ---- cues

_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x IN ('the', 'of', 'les', 'die'))"


@_query(rf"SELECT conv_id, CAST(turn AS DOUBLE) AS time FROM conversations WHERE len(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x IN ('that', 'pour'))) > 0")
def cue_markers(spark, sf):
    return signals.marker_times(_turns(spark, sf), [r"\bthat\b", r"\bpour\b"]).select(F.col("lecture_id").alias("conv_id"), "time")


@_query(f"""
    WITH c AS (SELECT conv_id, turn, len({_WORDS}) AS n FROM conversations),
    s AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM c),
    x AS (SELECT *, coalesce(lag(v) OVER w, v) AS l, coalesce(lead(v) OVER w, v) AS r FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, CAST(turn AS DOUBLE) AS time, CAST(v AS BIGINT) AS fillers FROM x WHERE v >= 3 AND v >= l AND v >= r""")
def filler_peaks(spark, sf):
    return signals.filler_peaks(_turns(spark, sf), ["the", "of", "les", "die"], 3, 2.0).select(F.col("lecture_id").alias("conv_id"), "time", "fillers")


# ---- joins on time

_NEAR = "abs(x.t - d.t) <= 3600"


@_query(f"WITH {_E} SELECT user_id, event_id AS boundary_index, t AS boundary_time FROM e d WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM e x WHERE x.user_id = d.user_id AND x.event_type = 'error' AND {_NEAR})")
def marker_gate(spark, sf):
    return J.gate(_dips(spark, sf), _of(spark, sf, "error", "i"), 3600.0, "marker_gated_semantic", "user_id").select("user_id", "boundary_index", "boundary_time")


@_query(f"WITH {_E} SELECT user_id, event_id AS boundary_index, t AS boundary_time FROM e d WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM e x WHERE x.user_id = d.user_id AND x.event_type = 'error' AND abs(x.t - d.t) <= 14400) AND EXISTS (SELECT 1 FROM e x WHERE x.user_id = d.user_id AND x.event_type = 'view' AND abs(x.t - d.t) <= 14400)")
def slide_gate_and(spark, sf):
    kept = J.gate(_dips(spark, sf), _of(spark, sf, "error", "i"), 14400.0, "marker_gated_semantic", "user_id")
    return J.gate(kept, _of(spark, sf, "view", "i"), 14400.0, "marker_gated_semantic_and_slide", "user_id").select("user_id", "boundary_index", "boundary_time")


@_query(f"""
    WITH {_E} SELECT user_id, t AS boundary_time, value AS similarity, 'marker_gated_semantic_or_slide' AS reason FROM e d WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM e x WHERE x.user_id = d.user_id AND x.event_type = 'error' AND {_NEAR})
    UNION ALL SELECT user_id, t, 1.0, 'marker_slide_aux' FROM e d WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM e x WHERE x.user_id = d.user_id AND x.event_type = 'error' AND {_NEAR})""")
def slide_or(spark, sf):
    return J.gate_or(_dips(spark, sf), _of(spark, sf, "error", "i"), _of(spark, sf, "view", "i"), 3600.0, "user_id").select("user_id", "boundary_time", "similarity", "reason")


@_query(f"""
    WITH {_E}, a AS (SELECT user_id, event_id AS anchor, t FROM e WHERE event_type = 'purchase')
    SELECT a.user_id, anchor, count(*) AS n, string_agg(event_type, ' ' ORDER BY event_id) AS snippet FROM a JOIN e ON e.user_id = a.user_id AND NOT (e.t + e.value * 10 < a.t - 7200 OR e.t > a.t + 7200) GROUP BY ALL""")
def interval_overlap_snippets(spark, sf):
    cues = _events(spark, sf).select("user_id", "event_id", "event_type", F.col("t").alias("start"), (F.col("t") + F.col("value") * 10).alias("end"))
    spans = _events(spark, sf).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("anchor"), (F.col("t") - 7200).alias("r_start"), (F.col("t") + 7200).alias("r_end"))
    hit = J.overlapping(cues, spans, 14400.0, True, "user_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), " ")
    return hit.groupBy("user_id", "anchor").agg(F.count("*").alias("n"), text.alias("snippet"))


@_query(f"WITH {_PG} SELECT g.user_id, g.gt_index, count(p.pred_index) AS n, coalesce(string_agg(CAST(p.pred_index AS VARCHAR), ';' ORDER BY p.pred_index), '') AS indices FROM g LEFT JOIN p ON p.user_id = g.user_id AND abs(p.time - g.time) <= 43200 GROUP BY ALL")
def density_per_anchor(spark, sf):
    points = _preds(spark, sf).select("user_id", F.col("time").alias("r_time"), F.col("pred_index").alias("r_idx"))
    return J.density(_truths(spark, sf), points, 43200.0, "user_id").select("user_id", "gt_index", "n", "indices")


def _nearest_sql(tie: str) -> str:
    return f"WITH {_PG}, x AS (SELECT p.user_id, p.pred_index, g.gt_index, g.time - p.time AS signed, row_number() OVER (PARTITION BY p.user_id, p.pred_index ORDER BY abs(g.time - p.time), {tie}) AS k FROM p JOIN g ON g.user_id = p.user_id) SELECT user_id, pred_index, gt_index, round(signed, 3) AS signed FROM x WHERE k = 1"


def _nearest(spark, sf, tie: str) -> DataFrame:
    right = _truths(spark, sf).select("user_id", F.col("time").alias("r_time"), F.col("gt_index").alias("r_idx"))
    found = J.nearest(_preds(spark, sf), right, "user_id", tie=tie).where("r_idx is not null")
    return found.select("user_id", "pred_index", F.col("r_idx").alias("gt_index"), F.round(F.col("r_time") - F.col("time"), 3).alias("signed"))


@_query(_nearest_sql("g.gt_index"))
def nearest_event(spark, sf):
    return _nearest(spark, sf, "index")


@_query(_nearest_sql("g.time DESC"))
def nearest_signed(spark, sf):
    return _nearest(spark, sf, "later")


@_query(f"""
    WITH {_E}, s AS (SELECT user_id, t, event_id, 'Section ' || event_id AS title FROM e WHERE event_type = 'signup'), f AS (SELECT user_id, arg_min(title, t) AS title FROM s GROUP BY user_id)
    SELECT c.user_id, c.event_id, coalesce(s.title, f.title, 'Unassigned Section') AS section FROM (SELECT * FROM e WHERE event_type = 'click') c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.t >= s.t LEFT JOIN f ON f.user_id = c.user_id""")
def asof_section(spark, sf):
    sections = _of(spark, sf, "signup", "gt_index", "event_id").select("user_id", "time", "gt_index", F.concat(F.lit("Section "), "event_id").alias("title"))
    rows = _of(spark, sf, "click", "pred_index", "event_id")
    return J.section_at(rows, sections, "user_id").select("user_id", "event_id", "section")


@_query(f"""
    WITH {_PG}, s AS (SELECT user_id, coalesce(lag(time) OVER (PARTITION BY user_id ORDER BY time), 0) AS a, time AS b FROM g UNION ALL SELECT user_id, max(time), NULL FROM g GROUP BY user_id),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY a, b NULLS LAST) - 1 AS INTEGER) AS segment FROM s)
    SELECT n.user_id, segment, round(a, 3) AS start, count(p.time) AS n FROM n LEFT JOIN p ON p.user_id = n.user_id AND p.time >= a AND (b IS NULL OR p.time < b) GROUP BY ALL""")
def segment_fill(spark, sf):
    return J.segments(_truths(spark, sf), _preds(spark, sf), "user_id").select("user_id", "segment", F.round("start", 3).alias("start"), "n")


@_query(f"WITH {_PG}, x AS (SELECT g.user_id, g.gt_index, p.pred_index, p.value, count(*) OVER (PARTITION BY g.user_id, g.gt_index) AS n, row_number() OVER (PARTITION BY g.user_id, g.gt_index ORDER BY p.value, p.pred_index) AS k FROM g JOIN p ON p.user_id = g.user_id AND abs(p.time - g.time) <= 86400) SELECT user_id, gt_index, value AS similarity, pred_index, n FROM x WHERE k = 1")
def zoom_argmin(spark, sf):
    points = _of(spark, sf, "click", "pred_index", "value").select("user_id", F.col("time").alias("r_time"), F.col("pred_index").alias("r_idx"), F.col("value").alias("similarity"))
    return J.lowest_within(_truths(spark, sf), points, 86400.0, seq="user_id").select("user_id", "gt_index", "similarity", F.col("r_idx").alias("pred_index"), "n")


# ---- matching and metrics

@_query(f"WITH RECURSIVE {_PREDS_TRUTHS_MATCH} SELECT user_id, gt_index, pred_index, round(abs_error_sec, 3) AS abs_error_sec FROM m")
def greedy_match(spark, sf):
    return E.greedy_match(_preds(spark, sf), _truths(spark, sf), TOL, "user_id").select("user_id", "gt_index", "pred_index", F.round("abs_error_sec", 3).alias("abs_error_sec"))


@_query(f"WITH RECURSIVE {_PREDS_TRUTHS_MATCH}, {_prf_sql('m', 'p', 'g', 'user_id')} SELECT user_id, pred_count, gt_count, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def prf_metrics(spark, sf):
    found = E.report(_preds(spark, sf), _truths(spark, sf), TOL, "user_id")
    return found.select("user_id", "pred_count", "gt_count", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@_query(f"WITH RECURSIVE {_PREDS_TRUTHS_MATCH} SELECT 'pred' AS side, user_id, pred_index AS idx FROM p ANTI JOIN m USING (user_id, pred_index) UNION ALL SELECT 'gt', user_id, gt_index FROM g ANTI JOIN m USING (user_id, gt_index)")
def unmatched(spark, sf):
    p, g = _preds(spark, sf), _truths(spark, sf)
    m = E.greedy_match(p, g, TOL, "user_id")
    rows = J.anti(p, m, "user_id", "pred_index").select(F.lit("pred").alias("side"), "user_id", F.col("pred_index").alias("idx"))
    return rows.unionByName(J.anti(g, m, "user_id", "gt_index").select(F.lit("gt").alias("side"), "user_id", F.col("gt_index").alias("idx")))


@_query(f"""
    WITH {_PG}, d AS (SELECT g.user_id, g.gt_index, min(abs(p.time - g.time)) AS d FROM g LEFT JOIN p ON p.user_id = g.user_id GROUP BY ALL)
    SELECT user_id, tolerance, count(*) AS gt_count, count(*) FILTER (d <= tolerance) AS hits, round(100 * count(*) FILTER (d <= tolerance) / count(*), 6) AS hit_rate FROM d, (VALUES (3600.0::DOUBLE), (14400.0), (43200.0)) x(tolerance) GROUP BY ALL""")
def tolerance_hit_rate(spark, sf):
    return E.hit_rates(_truths(spark, sf), _preds(spark, sf), [3600.0, 14400.0, 43200.0], "user_id").withColumn("hit_rate", F.round("hit_rate", 6))


_FALSE = f"""{_PREDS_TRUTHS_MATCH}, u AS (SELECT p.* FROM p ANTI JOIN m USING (user_id, pred_index)),
    fp AS (SELECT u.user_id, u.pred_index, min(abs(g.time - u.time)) AS d FROM u LEFT JOIN g ON g.user_id = u.user_id GROUP BY ALL),
    fb AS (SELECT *, CASE WHEN d <= 21600 THEN 'redundant_near_gt' WHEN d <= 86400 THEN 'offset_near_miss' ELSE 'spurious_far' END AS fp_bucket FROM fp)"""


def _false(spark, sf) -> DataFrame:
    return E.false_positives(_preds(spark, sf), _truths(spark, sf), TOL, 86400.0, "user_id")


@_query(f"""
    WITH RECURSIVE {_FALSE}, c AS (SELECT user_id, count(*) AS fp, count(*) FILTER (fp_bucket = 'redundant_near_gt') AS redundant_near_gt, count(*) FILTER (fp_bucket = 'offset_near_miss') AS offset_near_miss, count(*) FILTER (fp_bucket = 'spurious_far') AS spurious_far FROM fb GROUP BY user_id)
    SELECT *, round(100 * (redundant_near_gt / fp), 2) AS redundant_near_gt_pct, round(100 * (offset_near_miss / fp), 2) AS offset_near_miss_pct, round(100 * (spurious_far / fp), 2) AS spurious_far_pct FROM c""")
def fp_buckets(spark, sf):
    return E.bucket_shares(_false(spark, sf), "user_id")


@_query(f"WITH RECURSIVE {_FALSE}, x AS (SELECT *, CAST(row_number() OVER (ORDER BY d DESC NULLS LAST, user_id, pred_index) AS INTEGER) AS rank FROM fb WHERE fp_bucket = 'spurious_far') SELECT rank, user_id, pred_index, round(d, 3) AS distance FROM x WHERE rank <= 25")
def fp_review_topk(spark, sf):
    top = _false(spark, sf).where("fp_bucket = 'spurious_far'").orderBy(F.col("distance").desc_nulls_last(), "user_id", "pred_index").limit(25)
    rank = F.row_number().over(Window.orderBy(F.col("distance").desc_nulls_last(), "user_id", "pred_index"))
    return top.select(rank.alias("rank"), "user_id", "pred_index", F.round("distance", 3).alias("distance"))


# ---- sweeps and tables

_FUSE = [("One", "click"), ("Two", "click"), ("Two", "view"), ("All", "click"), ("All", "view"), ("All", "error")]


@_query(f"""
    WITH RECURSIVE {_E}, mm(setting, kind) AS (VALUES {', '.join(map(str, _FUSE))}), o AS (SELECT setting, user_id, t, row_number() OVER (PARTITION BY setting, user_id ORDER BY t, event_id) AS rn FROM e JOIN mm ON kind = event_type),
    r AS (SELECT setting, user_id, rn, t AS lt, true AS kept FROM o WHERE rn = 1
      UNION ALL SELECT o.setting, o.user_id, o.rn, CASE WHEN o.t - lt >= 21600 THEN o.t ELSE lt END, o.t - lt >= 21600 FROM r JOIN o ON o.setting = r.setting AND o.user_id = r.user_id AND o.rn = r.rn + 1)
    SELECT setting, user_id, lt AS time FROM r WHERE kept""")
def signal_fusion(spark, sf):
    models: dict[str, list[str]] = {}
    for model, kind in _FUSE:
        models.setdefault(model, []).append(kind)
    times = _events(spark, sf).select(F.col("user_id").alias("lecture_id"), F.col("event_type").alias("signal"), F.col("t").alias("time"))
    return experiments.fuse(times, models, 21600.0).withColumnRenamed("lecture_id", "user_id")


_DISTANCES = [3600.0, 43200.0, 172800.0]
_SWEEP = f"""{_PG}, ds(d) AS (VALUES {', '.join(f'({d}::DOUBLE)' for d in _DISTANCES)}),
    o AS (SELECT d, user_id, time, row_number() OVER (PARTITION BY d, user_id ORDER BY time, event_id) AS rn FROM p, ds),
    sp AS (SELECT d, user_id, rn, time AS lt, true AS kept FROM o WHERE rn = 1
      UNION ALL SELECT o.d, o.user_id, o.rn, CASE WHEN o.time - lt >= o.d THEN o.time ELSE lt END, o.time - lt >= o.d FROM sp JOIN o ON o.d = sp.d AND o.user_id = sp.user_id AND o.rn = sp.rn + 1),
    ps AS (SELECT CAST(CAST(d AS INTEGER) AS VARCHAR) || '/' || user_id AS k, d, user_id, lt AS time, CAST(row_number() OVER (PARTITION BY d, user_id ORDER BY lt) - 1 AS INTEGER) AS pred_index FROM sp WHERE kept),
    gs AS (SELECT CAST(CAST(d AS INTEGER) AS VARCHAR) || '/' || user_id AS k, d, user_id, time, gt_index FROM g, ds),
    {_greedy_sql('ps', 'gs', 'k', TOL)}, {_prf_sql('m', 'ps', 'gs', 'k')},
    sweep AS (SELECT 'd' || split_part(k, '/', 1) AS setting, CAST(split_part(k, '/', 2) AS BIGINT) AS user_id, * EXCLUDE (k) FROM f)"""


def _sweep(spark, sf) -> DataFrame:
    clicks = _of(spark, sf, "click", "pred_index", "event_id").select(F.col("user_id").alias("lecture_id"), "time", F.col("event_id").alias("idx"))
    settings = [{"setting": f"d{int(d)}", "distance": d} for d in _DISTANCES]
    found = folds.space_first(with_settings(clicks, settings, "setting string, distance double"), "distance", ["setting", "lecture_id"])
    return experiments.score_settings(found, _truths(spark, sf).withColumnRenamed("user_id", "lecture_id"), settings, TOL)


@_query(f"WITH RECURSIVE {_SWEEP} SELECT setting, user_id, pred_count, gt_count, tp, round(f1, 6) AS f1 FROM sweep")
def param_sweep(spark, sf):
    return _sweep(spark, sf).select("setting", F.col("lecture_id").alias("user_id"), "pred_count", "gt_count", "tp", F.round("f1", 6).alias("f1"))


def _mean_sql(c: str) -> str:
    """The mean of a column's 4-digit values, to 4 digits."""
    return f"CAST(printf('%.4f', CAST(sum(CAST(round_even(CAST(printf('%.4f', {c}) AS DOUBLE) * 10000, 0) AS BIGINT)) AS DOUBLE) / (count(*) * 10000)) AS DOUBLE)"


_GATES = [{"setting": f"v{t:g}_d{int(d)}_m{int(m)}", "threshold": t, "delta": d, "distance": m, "tolerance": tol} for t, d, m, tol in [(60.0, 3600.0, 21600.0, 21600.0), (60.0, 14400.0, 21600.0, 21600.0), (90.0, 14400.0, 43200.0, 43200.0), (90.0, 14400.0, 0.0, 3600.0)]]


@_query(f"""
    WITH RECURSIVE {_PG}, ss(setting, threshold, delta, distance, tol) AS (VALUES {', '.join(str((g["setting"], g["threshold"], g["delta"], g["distance"], g["tolerance"])) for g in _GATES)}),
    kept AS (SELECT setting, distance::DOUBLE AS dd, tol::DOUBLE AS tol, user_id, time, event_id, value FROM p, ss WHERE value < threshold AND EXISTS (SELECT 1 FROM e x WHERE x.user_id = p.user_id AND x.event_type = 'error' AND abs(x.t - p.time) <= delta)),
    o AS (SELECT *, row_number() OVER (PARTITION BY setting, user_id ORDER BY time, value, event_id) AS rn FROM kept),
    sp AS (SELECT setting, dd, tol, user_id, rn, 1 AS k, time AS lt, value AS lv FROM o WHERE rn = 1
      UNION ALL SELECT o.setting, o.dd, o.tol, o.user_id, o.rn, CASE WHEN o.time - lt >= o.dd THEN k + 1 ELSE k END,
        CASE WHEN o.time - lt >= o.dd OR o.value < lv THEN o.time ELSE lt END, CASE WHEN o.time - lt >= o.dd OR o.value < lv THEN o.value ELSE lv END
      FROM sp JOIN o ON o.setting = sp.setting AND o.user_id = sp.user_id AND o.rn = sp.rn + 1),
    ps AS (SELECT setting || '/' || user_id AS k, tol, time, CAST(row_number() OVER (PARTITION BY setting, user_id ORDER BY time) - 1 AS INTEGER) AS pred_index FROM (SELECT setting, tol, user_id, arg_max(lt, rn) AS time FROM sp GROUP BY setting, tol, user_id, k)),
    gs AS (SELECT setting || '/' || user_id AS k, time, gt_index FROM g, ss),
    {_greedy_sql('ps', 'gs', 'k', "p.tol")}, {_prf_sql('m', 'ps', 'gs', 'k')}
    SELECT split_part(k, '/', 1) AS setting, CAST(split_part(k, '/', 2) AS BIGINT) AS user_id, pred_count, gt_count, tp, round(f1, 6) AS f1 FROM f""")
def gate_sweep(spark, sf):
    """Dips under a threshold that have a marker within delta, spaced, under settings that differ in all of these."""
    dips = _dips(spark, sf).select(F.col("user_id").alias("lecture_id"), F.col("boundary_index").alias("left_window_id"), F.col("boundary_time").alias("right_start"), "similarity")
    named = lambda rows: rows.withColumnRenamed("user_id", "lecture_id")
    found = experiments.boundary_sweep(dips, _GATES, named(_of(spark, sf, "error", "idx"))).withColumnRenamed("boundary_time", "time")
    rows = experiments.score_settings(found, named(_truths(spark, sf)), _GATES)
    return rows.select("setting", F.col("lecture_id").alias("user_id"), "pred_count", "gt_count", "tp", F.round("f1", 6).alias("f1"))


@_query(f"WITH RECURSIVE {_SWEEP} SELECT setting, {_mean_sql("precision")} AS avg_precision, {_mean_sql("recall")} AS avg_recall, {_mean_sql("f1")} AS avg_f1, round(avg(pred_count), 2) AS avg_pred_count, count(*) AS n FROM sweep GROUP BY setting")
def macro_average(spark, sf):
    """Means of four digits, rounded as their exact binary values say."""
    return E.macro_average(_sweep(spark, sf), "setting").select("setting", "avg_precision", "avg_recall", "avg_f1", "avg_pred_count", "n")


_F1_COLUMNS = ", ".join(f"coalesce(max(round(f1, 6)) FILTER (setting = 'd{int(d)}'), 0) AS d{int(d)}" for d in _DISTANCES)


@_query(f"WITH RECURSIVE {_SWEEP}, x AS (SELECT user_id, {_F1_COLUMNS} FROM sweep GROUP BY user_id) SELECT * FROM x UNION ALL SELECT NULL, {', '.join(f'round(avg(d{int(d)}), 6)' for d in _DISTANCES)} FROM x HAVING count(*) > 0")
def f1_matrix(spark, sf):
    """A row per user, a column per setting; the row without a user holds the averages over all users."""
    names = [f"d{int(d)}" for d in _DISTANCES]
    rows = _sweep(spark, sf).withColumn("f1", F.round("f1", 6))
    wide = E.pivot_f1(rows, "lecture_id", names, "setting").select(F.col("lecture_id").alias("user_id"), *names)
    means = wide.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in names)).where("n > 0")
    return wide.unionByName(means.select(F.lit(None).cast("long").alias("user_id"), *names))


@_query(f"WITH RECURSIVE {_SWEEP} SELECT user_id, setting, f1 FROM (SELECT user_id, setting, round(f1, 6) AS f1, row_number() OVER (PARTITION BY user_id ORDER BY round(f1, 6) DESC, CAST(setting[2:] AS INTEGER)) AS k FROM sweep) WHERE k = 1")
def best_setting(spark, sf):
    rows = _sweep(spark, sf).select(F.col("lecture_id").alias("user_id"), "setting", F.round("f1", 6).alias("f1"), F.substring("setting", 2, 9).cast("int").alias("place"))
    return E.best_row(rows, "f1", "place", "user_id").select("user_id", "setting", "f1")


@_query(f"WITH RECURSIVE {_SWEEP}, b AS (SELECT s.setting, s.f1 - coalesce(x.f1, 0) AS d FROM sweep s LEFT JOIN (SELECT * FROM sweep WHERE setting = 'd3600') x ON x.user_id = s.user_id) SELECT setting, count(*) FILTER (d > 1e-6) AS improved, count(*) FILTER (d < -1e-6) AS worse, count(*) FILTER (abs(d) <= 1e-6) AS unchanged FROM b GROUP BY setting")
def improvement_counts(spark, sf):
    rows = _sweep(spark, sf)
    return E.improvements(rows, rows.where("setting = 'd3600'"), "setting")


_VERSIONS = f"""{_PREDS_TRUTHS_MATCH}, {_prf_sql('m', 'p', 'g', 'user_id')}, g2 AS (SELECT user_id, time + 3600 AS time, gt_index FROM g), {_greedy_sql('p', 'g2', 'user_id', TOL, 'm2')}, {_prf_sql('m2', 'p', 'g2', 'user_id', 'f2')}"""


@_query(f"WITH RECURSIVE {_VERSIONS} SELECT f.user_id, round(f.f1, 6) AS f1_orig, round(f2.f1, 6) AS f1_corrected, round(f2.f1 - f.f1, 6) AS delta_f1 FROM f JOIN f2 ON f2.user_id = f.user_id")
def gt_version_delta(spark, sf):
    p, g = _preds(spark, sf), _truths(spark, sf)
    both = E.compare_versions(E.report(p, g, TOL, "user_id"), E.report(p, g.withColumn("time", F.col("time") + 3600), TOL, "user_id"), "user_id")
    return both.select("user_id", *(F.round(c, 6).alias(c) for c in ("f1_orig", "f1_corrected", "delta_f1")))


# ---- labels

def _rx(pattern: str) -> str:
    return pattern.replace("'", "''")


_LABEL_SQL = "CASE WHEN length(trim(text)) < 16 OR " + " OR ".join(f"regexp_matches(trim(text), '(?i){_rx(p)}')" for p in L.EXCLUDED) + " THEN NULL " + " ".join(f"WHEN regexp_matches(text, '(?i){_rx(p)}') THEN '{n}'" for n, p in L.CLASSES) + " END"
_TOPIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{_rx(p)}') THEN '{n}'" for p, n in L.TOPICS) + " WHEN contains(lower(text), 'example') THEN 'Worked Example' WHEN regexp_matches(lower(text), 'define|definition|what is') THEN 'Concept Definition' ELSE 'General Explanation' END"
_KEPT_SQL = ", ".join(f"'{t}'" for t in L.KEPT_TOPICS)
_SCHEMA_SQL = f"""CASE WHEN raw IN ({_KEPT_SQL}) THEN raw WHEN label = 'A_Concept_Introduction' AND regexp_matches(lower(text), 'definition|what is') THEN 'Concept Definition'
      WHEN label = 'A_Concept_Introduction' THEN 'Core Concept' WHEN label = 'B_Worked_Example' THEN 'Worked Example' WHEN label = 'C_Explanation_Shift_Major' THEN 'Theory-to-Practice Shift'
      WHEN label = 'D_Practical_Important_Point' THEN 'Practical Guidance' WHEN label = 'E1_High_Value_QA' AND regexp_matches(lower(text), 'how do|how to') THEN 'Technical Clarification'
      WHEN label = 'E1_High_Value_QA' THEN 'High-value Clarification' WHEN label = 'E2_Minor_QA' THEN 'Minor Clarification' ELSE 'General Topic' END"""


_DRAFT_SQL = f"""
    c AS (SELECT user_id, event_id, t / 600 AS t, {_SPEECH_SQL} AS text FROM e), l AS (SELECT *, {_LABEL_SQL} AS cls, {_TOPIC_SQL} AS raw FROM c),
    v AS (SELECT user_id, event_id, t, text, raw, CASE WHEN cls <> 'E_High_Value_QA' THEN cls WHEN CAST(length(text) >= 45 AS INTEGER) + CAST(regexp_matches(lower(text), '{"|".join(L.QA_TERMS)}') AS INTEGER) + CAST(raw NOT IN ('Student Clarification', 'General Explanation') AS INTEGER) >= 2 THEN 'E1_High_Value_QA' ELSE 'E2_Minor_QA' END AS label FROM l WHERE cls IS NOT NULL),
    k AS (SELECT *, {_SCHEMA_SQL} AS topic FROM v)"""


@_query(f"WITH {_E}, {_DRAFT_SQL} SELECT user_id, event_id, label, raw AS raw_topic, topic FROM k")
def draft_labels(spark, sf):
    rows = experiments.draft_labels(_speech(spark, sf))
    return rows.select(F.col("lecture_id").alias("user_id"), F.col("idx").alias("event_id"), "label", L.topic(F.col("text")).alias("raw_topic"), "topic")


_RANK_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in folds.PRIORITY.items()) + " ELSE 0 END"
_FAMILY_SQL = "({0} = {1} OR {0} IN (" + (_f := ", ".join(f"'{t}'" for t in L.CONCEPT_FAMILY)) + ") AND {1} IN (" + _f + "))"


def _chain_sql(join: str, merged: str) -> str:
    """Fold of xs in which b[1] takes the place of a[-1], as ``merged``, where ``join`` holds, or is appended."""
    return f"list_reduce(list_transform(xs, lambda x: [x]), lambda a, b: CASE WHEN {join} THEN list_concat(a[:-2], [{merged}]) ELSE list_concat(a, b) END)"


def _segment_sql(first: str, topic: str, text: str, label: str | None = None) -> str:
    return f"{{'time': {first}.time, 'label': {label or first + '.label'}, 'topic': {topic}, 'text': {text}}}"


_NOTES_SQL = "a[-1].text || ' || ' || b[1].text"
_EITHER_SQL = "CASE WHEN 'AI Definition' IN ({0}.topic, {1}.topic) THEN 'AI Definition' {2} END"
_MERGE_SQL = f"""
    s0 AS (SELECT user_id, list({{'time': t, 'label': label, 'topic': topic, 'text': text}} ORDER BY t, event_id) AS xs FROM k GROUP BY user_id),
    s1 AS (SELECT user_id, list_reduce(list_transform(xs, lambda x: [x]), lambda a, b: CASE WHEN b[1].time - a[-1].time >= 25 THEN list_concat(a, b)
      WHEN {_RANK_SQL.format("b[1].label")} > {_RANK_SQL.format("a[-1].label")} THEN list_concat(a[:-2], b) ELSE a END) AS xs FROM s0),
    s2 AS (SELECT user_id, {_chain_sql("b[1].label = a[-1].label AND b[1].topic = a[-1].topic AND b[1].time - a[-1].time <= 90", _segment_sql("a[-1]", "a[-1].topic", _NOTES_SQL))} AS xs FROM s1),
    s3 AS (SELECT user_id, {_chain_sql("starts_with(a[-1].label, 'A_') AND starts_with(b[1].label, 'A_') AND " + _FAMILY_SQL.format("a[-1].topic", "b[1].topic") + " AND b[1].time - a[-1].time <= 240",
      _segment_sql("a[-1]", _EITHER_SQL.format("a[-1]", "b[1]", f"WHEN a[-1].topic IN ({_f}) THEN a[-1].topic ELSE b[1].topic"), _NOTES_SQL))} AS xs FROM s2),
    s4 AS (SELECT user_id, xs, list_filter(range(1, len(xs) - 1), lambda i: starts_with(xs[i].label, 'A_') AND xs[i + 1].label = 'E2_Minor_QA' AND starts_with(xs[i + 2].label, 'A_')
      AND xs[i + 2].time - xs[i].time <= 180 AND {_FAMILY_SQL.format("xs[i].topic", "xs[i + 2].topic")}) AS hits FROM s3),
    s5 AS (SELECT user_id, xs, CASE WHEN len(hits) > 0 THEN list_reduce(list_transform(hits, lambda i: [i]), lambda a, b: CASE WHEN b[1] >= a[-1] + 3 THEN list_concat(a, b) ELSE a END) ELSE hits END AS hits FROM s4),
    s6 AS (SELECT user_id, list_transform(list_filter(range(1, len(xs) + 1), lambda i: NOT list_contains(hits, i - 1) AND NOT list_contains(hits, i - 2)), lambda i: CASE WHEN list_contains(hits, i)
      THEN {_segment_sql("xs[i]", _EITHER_SQL.format("xs[i]", "xs[i + 2]", "ELSE xs[i].topic"), "xs[i].text || ' || ' || xs[i + 1].text || ' || ' || xs[i + 2].text", "'A_Concept_Introduction'")} ELSE xs[i] END) AS xs FROM s5)"""


@_query(f"""
    WITH {_E}, {_DRAFT_SQL}, {_MERGE_SQL}, n AS (SELECT user_id, generate_subscripts(xs, 1) AS seg_index, unnest(xs) AS s FROM s6)
    SELECT user_id, CAST(seg_index AS INTEGER) AS seg_index, round(s.time, 3) AS time, s.label AS label, s.topic AS topic, s.text AS text FROM n""")
def label_merge(spark, sf):
    merged = folds.merge_labels(experiments.draft_labels(_speech(spark, sf).repartition("lecture_id")))
    return merged.select(F.col("lecture_id").alias("user_id"), "seg_index", F.round("time", 3).alias("time"), "label", "topic", "text")


# ---- keyed tables and frames

@_query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'N' FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus <> 'F'")
def keyed_replace(spark, sf):
    old = _table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = old.where("o_orderkey % 10 = 0 AND o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("N"))
    return sinks.replace_keyed(old, new, "o_orderkey")


@_query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def id_intersect(spark, sf):
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).intersect(_table(spark, sf, "orders").select("o_custkey"))


@_query("SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier")
def id_union(spark, sf):
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).union(_table(spark, sf, "supplier").select("s_suppkey")).distinct()


@_query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def id_difference(spark, sf):
    return J.anti(_table(spark, sf, "documents").select("doc_id").distinct(), _table(spark, sf, "labels"), "doc_id")


@_query(f"""
    WITH {_E}, f AS (SELECT user_id, CAST(floor(t * 1000) AS BIGINT) AS ms, value, avg(value) OVER (PARTITION BY user_id) AS mean FROM e),
    q AS (SELECT *, value <= mean - 16 AS quiet FROM f),
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms) - row_number() OVER (PARTITION BY user_id, quiet ORDER BY ms) AS island FROM q),
    s AS (SELECT user_id, min(ms) AS a, max(ms) AS b FROM i WHERE quiet GROUP BY user_id, island)
    SELECT user_id, a AS start_ms, b AS end_ms, (a + b) // 2 AS mid_ms FROM s WHERE b - a >= 1000""")
def frame_silence(spark, sf):
    frames = _events(spark, sf).select(F.col("user_id").alias("seq_id"), F.floor(F.col("t") * 1000).alias("ms"), F.col("value").alias("energy"), "event_id")
    return transcripts.audio_frames_silence(frames, ties="event_id").withColumnRenamed("seq_id", "user_id")


@_query(f"""
    WITH {_E}, x AS (SELECT event_id, value, CAST(round_even(value * 100, 0) AS BIGINT) AS c, CAST(floor(value * 1000) AS BIGINT) AS ms FROM e)
    SELECT event_id, printf('%02d:%02d.%02d', c // 6000, c % 6000 // 100, c % 100) AS mmss, printf('%02d:%02d:%02d.%02d', c // 360000, c % 360000 // 6000, c % 6000 // 100, c % 100) AS hmsc,
      CASE WHEN value <= 10 THEN 'yes' ELSE 'no' END AS flag, round(CAST(c AS DOUBLE) / 100, 2) AS back, 1.0 - value AS inverted FROM x""")
def time_display(spark, sf):
    """Clock formats of two and three parts with hundredths, and the two-part clock with a comma read back."""
    v = F.col("value")
    mmss = X.minutes_centis(v)
    back = F.round(X.clock_seconds(F.replace(mmss, F.lit("."), F.lit(","))), 2)
    return _events(spark, sf).select("event_id", mmss.alias("mmss"), X.hms_centis(v).alias("hmsc"), X.tick(v <= 10, "yes", "no").alias("flag"), back.alias("back"), dissimilarity(v).alias("inverted"))


@_query(r"""
    WITH t AS (SELECT conv_id, turn, '<b>"' || text || '" & ' || role AS raw FROM conversations),
    p AS (SELECT *, trim(regexp_replace(raw, '[^A-Za-z0-9 ,.''-]', '', 'g')) AS plain FROM t)
    SELECT conv_id, turn, replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
      CASE WHEN length(plain) > 80 THEN rtrim(plain[:77]) || '...' ELSE plain END AS note, try_cast(conv_id || '.5' AS DOUBLE) AS number, coalesce(try_cast('x' || conv_id AS DOUBLE), -1.0) AS none FROM p""")
def note_text(spark, sf):
    raw = F.concat(F.lit('<b>"'), "text", F.lit('" & '), "role")
    number = F.concat(F.col("conv_id").cast("string"), F.lit(".5"))
    return _table(spark, sf, "conversations").select("conv_id", "turn", X.html_escape(raw).alias("escaped"), X.short_note(raw).alias("note"), X.safe_double(number).alias("number"), X.safe_double(F.concat(F.lit("x"), F.col("conv_id").cast("string")), -1.0).alias("none"))


@_query(f"""
    WITH {_PG}, d AS (SELECT p.user_id, p.pred_index, min(abs(g.time - p.time)) AS d FROM p LEFT JOIN g ON g.user_id = p.user_id GROUP BY ALL)
    SELECT user_id, pred_index, CASE WHEN d IS NULL THEN 'no' WHEN d <= 3600 THEN printf('yes Δ=%.1fs', d) ELSE printf('no (nearest %.0fs)', d) END AS note, round(86400 - d, 4) AS delta FROM d""")
def proximity_kind(spark, sf):
    """Notes on the nearest truth, and the difference to a reference distance."""
    right = _truths(spark, sf).select("user_id", F.col("time").alias("r_time"), F.col("gt_index").alias("r_idx"))
    near = J.nearest(_preds(spark, sf), right, "user_id")
    rows = near.select("user_id", "pred_index", X.proximity_note(F.col("distance"), 3600.0).alias("note"), (-F.col("distance")).alias("back"))
    return experiments.delta_to(rows, "back", -86400.0).drop("back")


@_query(f"WITH {_E} SELECT user_id, count(*) FILTER (event_type = 'click') AS dips, count(*) FILTER (event_type = 'view') AS slides, count(*) FILTER (event_type = 'error') AS markers FROM e WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id")
def stage_counts(spark, sf):
    rows = _events(spark, sf)
    of = {"dips": "click", "slides": "view", "markers": "error"}
    return experiments.stage_counts({name: rows.where(F.col("event_type") == kind) for name, kind in of.items()}, "user_id")


# ---- files, by what they hold

@_query(r"""
    WITH t AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS k, text FROM conversations)
    SELECT conv_id, k AS block_id, k * CAST(7.25 AS DOUBLE) AS start, k * CAST(7.25 AS DOUBLE) + 6.5 AS "end", trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\[(.*?)\]', '', 'g'), '\s+', ' ', 'g')) AS text FROM t""".replace("\\\\", "\\"))
def vtt_round_trip(spark, sf):
    """Conversations as bodies of caption files (ids, notes, markup, several lines a cue), taken apart again."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    clock = lambda ms: F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)
    start = F.col("k").cast("long") * 7250
    lines = F.regexp_replace("text", r"\n\s*", "\n")
    cue = F.concat(F.when(F.col("k") % 2 == 0, F.concat("k", F.lit("\n"))).otherwise(F.lit("NOTE of no use\n\n")), clock(start), F.lit(" --> "), clock(start + 6500), F.lit(" align:left\n<v "), "role", F.lit(">"), lines, F.lit("</v> [noise]"))
    cues = _table(spark, sf, "conversations").select("conv_id", "role", "text", place.alias("k")).select("conv_id", "k", cue.alias("cue"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "cue"))), lambda x: x["cue"]), "\n\n")
    files = cues.groupBy(F.col("conv_id").alias("lecture_id")).agg(F.concat(F.lit("WEBVTT\n\n"), whole).alias("body"))
    return transcripts.cues_of(files, "strict").withColumnRenamed("lecture_id", "conv_id")


@_query(f"""
    WITH {_E}, x AS (SELECT user_id, event_type, event_id, CAST(floor(t) AS BIGINT) % 359999 AS s, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) - 1 AS INTEGER) AS i FROM e)
    SELECT user_id, 'section' AS kind, i AS place, CAST(s AS DOUBLE) AS time, 'S' || event_id AS seg_id, 'Part ' || i AS section, 'Topic ' || event_id AS topic FROM x WHERE event_type = 'signup'
    UNION ALL SELECT user_id, 'slide', NULL, s, NULL, NULL, NULL FROM x WHERE event_type = 'view'
    UNION ALL SELECT user_id, 'silence', NULL, s % 3599 + 0.25, NULL, NULL, NULL FROM x WHERE event_type = 'error'""")
def annotation_round_trip(spark, sf):
    """Events as bodies of annotation, slide and silence files, taken apart again."""
    w = Window.partitionBy("user_id", "event_type").orderBy("t", "event_id")
    rows = _events(spark, sf).select("user_id", "event_type", "event_id", (F.floor("t") % 359999).alias("s"), (F.row_number().over(w) - 1).alias("i"))
    mmss = F.col("s") % 3599
    line = (
        F.when(F.col("event_type") == "signup", F.concat(X.hms_floor(F.col("s")), F.lit(" S"), "event_id", F.lit("\tA_Concept_Introduction\tPart "), "i", F.lit(" : Topic "), "event_id"))
        .when(F.col("event_type") == "view", F.concat(X.hms_floor(F.col("s")), F.lit(" shown\n# a note")))
        .when(F.col("event_type") == "error", F.format_string("%02d:%02d.259", F.floor(mmss / 60), mmss % 60))
    )
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\nnot of this kind\n")
    files = rows.where(line.isNotNull()).groupBy(F.col("user_id").alias("lecture_id"), "event_type").agg(F.concat(F.lit("\n"), said).alias("body"))
    lines = lambda kind: transcripts.lines_of(files.where(F.col("event_type") == kind))
    sections = transcripts.fine_parts(transcripts.boundaries_of(lines("signup"))).select("lecture_id", F.lit("section").alias("kind"), F.col("gt_index").alias("place"), "time", "seg_id", "section", "topic")
    slides = transcripts.slides_of(lines("view")).select("lecture_id", F.lit("slide").alias("kind"), "time")
    quiet = transcripts.silences_of(lines("error")).select("lecture_id", F.lit("silence").alias("kind"), "time")
    return sections.unionByName(slides, allowMissingColumns=True).unionByName(quiet, allowMissingColumns=True).withColumnRenamed("lecture_id", "user_id")


@_query(f"""
    WITH {_E}, f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS ms, CAST(floor(value * 10) * floor(value * 10) AS BIGINT) AS energy FROM e),
    l AS (SELECT user_id, floor(sqrt(sum(energy)::DOUBLE / count(*))) * power(10::DOUBLE, -3 / 20.0) AS lim FROM f GROUP BY user_id),
    s AS (SELECT f.user_id, ms, floor(sqrt((sum(energy) OVER w)::DOUBLE / 5)) AS rms, count(*) OVER w AS n, lim FROM f JOIN l USING (user_id) WINDOW w AS (PARTITION BY f.user_id ORDER BY ms ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    q AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) > 5 THEN 1 ELSE 0 END AS new FROM s WHERE n = 5 AND rms <= lim),
    r AS (SELECT user_id, ms, sum(new) OVER (PARTITION BY user_id ORDER BY ms) AS run FROM q)
    SELECT user_id, min(ms) AS start_ms, max(ms) + 5 AS end_ms, (min(ms) + max(ms) + 5) // 2 AS mid_ms FROM r GROUP BY user_id, run""")
def quiet_windows(spark, sf):
    """Quiet stretches by the energy of sliding windows, in ranges shorter than the sequences: an event is a millisecond."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    level = F.floor(F.col("value") * 10)
    frames = _events(spark, sf).select(F.col("user_id").alias("seq_id"), (F.row_number().over(w) - 1).cast("long").alias("ms"), (level * level).alias("energy"), F.lit(1).cast("long").alias("samples"))
    return audio.quiet_stretches(frames, 5, 3.0, span=50).withColumnRenamed("seq_id", "user_id")


# ---- a stated model

_WIDTH = 3
_COUNTS = ["e", "t", "a", " "]


def _model():
    """Texts to counts of a few characters, and one: stands for a model that is costly to load."""
    import numpy as np

    return lambda texts: np.array([[t.count(c) for c in _COUNTS] + [1] for t in texts], float)


def _cos_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


_VECTOR_SQL = "[" + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in _COUNTS) + ", 1.0]"


@_query(f"""
    WITH w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS window_id, list(text) OVER x AS texts FROM conversations WINDOW x AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND {_WIDTH - 1} FOLLOWING)),
    v AS (SELECT conv_id, CAST(window_id AS INTEGER) AS window_id, {_VECTOR_SQL} AS x FROM (SELECT *, array_to_string(texts, ' ') AS text FROM w WHERE len(texts) = {_WIDTH})),
    n AS (SELECT *, lead(window_id) OVER o AS next_id, lead(x) OVER o AS y FROM v WINDOW o AS (PARTITION BY conv_id ORDER BY window_id))
    SELECT conv_id, window_id AS left_window_id, next_id AS right_window_id, round({_cos_sql("x", "y")}, 6) AS similarity FROM n WHERE next_id IS NOT NULL""")
def model_edges(spark, sf):
    """Windows of turns, embedded by a model that each worker loads once, and the edges between them."""
    units = _turns(spark, sf).withColumnRenamed("block_id", "sentence_id")
    edges = signals.adjacent_similarity(embed(sequences.sliding_windows(units, _WIDTH), _model))
    return edges.select(F.col("lecture_id").alias("conv_id"), "left_window_id", "right_window_id", F.round("similarity", 6).alias("similarity"))


_SIZES = [("sentence", 2), ("sentence", 4), ("time", 1.5), ("time", 3.0)]


@_query(f"""
    WITH t AS (SELECT conv_id, turn, text, regexp_replace(text, '[.!?]', '', 'g') AS plain, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
    sw AS (SELECT 'sentence_' || s AS setting, conv_id, k AS window_id, list(plain) OVER x AS texts, s FROM t, (VALUES (2), (4)) v(s) WINDOW x AS (PARTITION BY s, conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
    s AS (SELECT setting, conv_id, window_id, array_to_string(texts[:s], ' ') AS text FROM sw WHERE len(texts) >= s),
    span AS (SELECT conv_id, arg_min(turn, turn)::DOUBLE AS t0, (arg_max(turn, turn) + 1)::DOUBLE AS t1 FROM t GROUP BY conv_id),
    tw AS (SELECT d, conv_id, t0, unnest(generate_series(0, CAST(ceil((t1 - t0) / d) AS BIGINT) - 1)) AS j FROM span, (VALUES (1.5::DOUBLE), (3.0)) v(d)),
    h AS (SELECT 'time_' || CASE WHEN d = 1.5 THEN '1.5' ELSE '3' END AS setting, tw.conv_id, j, string_agg(text, ' ' ORDER BY turn) AS text FROM tw JOIN t ON t.conv_id = tw.conv_id AND t.turn + 1 > t0 + j * d AND t.turn < t0 + j * d + d GROUP BY ALL),
    w AS (SELECT * FROM s UNION ALL SELECT setting, conv_id, row_number() OVER (PARTITION BY setting, conv_id ORDER BY j) - 1, text FROM h),
    v AS (SELECT setting, conv_id, CAST(window_id AS INTEGER) AS window_id, {_VECTOR_SQL} AS x FROM w),
    n AS (SELECT *, lead(window_id) OVER o AS next_id, lead(x) OVER o AS y FROM v WINDOW o AS (PARTITION BY setting, conv_id ORDER BY window_id))
    SELECT setting, conv_id, window_id AS left_window_id, round({_cos_sql("x", "y")}, 6) AS similarity FROM n WHERE next_id IS NOT NULL""")
def representation_edges(spark, sf):
    """Edges of sentence windows of cleaned turns and of time windows of raw ones, of two sizes each: a pass for each kind."""
    raw = _turns(spark, sf)
    # one sentence to a turn, which is long enough to stand alone
    clean = raw.withColumn("text", F.regexp_replace("text", "[.!?]", ""))
    whole = ["setting", "lecture_id"]
    edges = signals.adjacent_similarity(embed(experiments.windows_of_settings(clean, raw, _SIZES, 1), _model), whole)
    return edges.select("setting", F.col("lecture_id").alias("conv_id"), "left_window_id", F.round("similarity", 6).alias("similarity"))


# ---- what plots and reports show

_PIXELS = 12
_CURVE = f"""{_EDGES}, c AS (SELECT lecture_id, CAST(right_window_id AS DOUBLE) AS x, similarity AS y FROM edges)"""


def _thin_sql(points: str, keys: str) -> str:
    return f"""SELECT {keys}, k AS "column", u.x AS x, u.y AS y FROM (SELECT {keys}, k, unnest(list_distinct([
        {{'x': min(x), 'y': arg_min(y, x)}}, (min({{'y': y, 'x': x, 'p': {{'x': x, 'y': y}}}})).p, (max({{'y': y, 'n': -x, 'p': {{'x': x, 'y': y}}}})).p, {{'x': max(x), 'y': arg_max(y, x)}}])) AS u FROM {points} GROUP BY {keys}, k)"""


@_query(f"""
    WITH {_CURVE}, p AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1 FROM c WINDOW w AS (PARTITION BY lecture_id)),
    q AS (SELECT lecture_id, x, y, CAST(CASE WHEN x1 > x0 THEN greatest(0, least({_PIXELS - 1}, floor((x - x0) / (x1 - x0) * {_PIXELS}))) ELSE 0 END AS INTEGER) AS k FROM p)
    {_thin_sql("q", "lecture_id")}""")
def plot_overview(spark, sf):
    return plots.overview(_edges(spark, sf), _PIXELS)


def _anchors(spark, sf) -> DataFrame:
    """Truths for the curves of _edges: every 23rd window's start."""
    rows = _edges(spark, sf).where("right_window_id % 23 = 0")
    return rows.select("lecture_id", F.col("right_window_id").alias("gt_index"), F.col("right_start").alias("time"))


_ZOOM = f"""{_DIPS}, c AS (SELECT lecture_id, CAST(right_window_id AS DOUBLE) AS x, 1 - similarity AS y FROM edges), pr AS (SELECT lecture_id, CAST(right_window_id AS DOUBLE) AS x FROM x WHERE similarity < 0.05 AND low),
    g AS (SELECT lecture_id, right_window_id AS gt_index, CAST(right_window_id AS DOUBLE) AS t, row_number() OVER (PARTITION BY lecture_id ORDER BY right_window_id) - 1 AS i, count(*) OVER (PARTITION BY lecture_id) AS n FROM edges WHERE right_window_id % 23 = 0)"""


@_query(f"""
    WITH {_ZOOM}, d AS (SELECT g.lecture_id, gt_index, min({{'y': y, 'x': x}}) AS d FROM g JOIN c ON c.lecture_id = g.lecture_id AND abs(c.x - t) <= 40 GROUP BY ALL),
    l AS (SELECT g.lecture_id, gt_index, string_agg(CAST(CAST(pr.x AS INTEGER) AS VARCHAR), ';' ORDER BY pr.x) AS preds FROM g JOIN pr ON pr.lecture_id = g.lecture_id AND abs(pr.x - t) <= 40 GROUP BY ALL)
    SELECT g.lecture_id, g.gt_index, CAST(i // 3 AS INTEGER) AS "row", CAST(i % 3 AS INTEGER) AS col, CAST(ceil(n / 3) AS INTEGER) AS "rows", t - 40 AS x_min, t + 40 AS x_max, coalesce(preds, '') AS preds, d.d.x AS dip_x, round(d.d.y, 6) AS dip_y
    FROM g LEFT JOIN d USING (lecture_id, gt_index) LEFT JOIN l USING (lecture_id, gt_index)""")
def plot_zoom_panels(spark, sf):
    edges = _edges(spark, sf)
    found = plots.zoom_panels(edges, _anchors(spark, sf), signals.dips(edges, 0.05), 40.0, invert=True)
    preds = F.array_join(F.transform("preds", lambda x: x.cast("int").cast("string")), ";")
    return found.withColumns({"preds": preds, "dip_y": F.round("dip_y", 6)})


@_query(f"""
    WITH {_ZOOM}, s AS (SELECT lecture_id, x, y, coalesce(lead(x) OVER w, x) AS nx, coalesce(lead(y) OVER w, y) AS ny FROM c WINDOW w AS (PARTITION BY lecture_id ORDER BY x)),
    m AS (SELECT g.lecture_id, gt_index, t, s.* EXCLUDE (lecture_id) FROM g JOIN s ON s.lecture_id = g.lecture_id AND s.nx >= t - 40 AND s.x <= t + 40),
    e2 AS (SELECT lecture_id, gt_index, t, x, y FROM m UNION SELECT lecture_id, gt_index, t, nx, ny FROM m),
    q AS (SELECT lecture_id, gt_index, x, y, CAST(CASE WHEN x < t - 40 THEN -1 WHEN x > t + 40 THEN 8 ELSE least(7, floor((x - t + 40) / 80 * 8)) END AS INTEGER) AS k FROM e2)
    SELECT lecture_id, gt_index, "column", x, round(y, 6) AS y FROM ({_thin_sql("q", "lecture_id, gt_index")})""")
def plot_zoom_curves(spark, sf):
    return plots.zoom_curves(_edges(spark, sf), _anchors(spark, sf), 40.0, 8, invert=True).withColumn("y", F.round("y", 6))


#: Result files as runs leave them: each family's table has a header of its own.
_FAMILIES = [("expA_summary_table", "click", "Representation"), ("expB_window_size_summary", "view", "Window Size"), ("expD_model_comparison", "purchase", "Model"), ("expF1_marker_gated_summary", "error", "Setting"), ("expF2_prominence_summary", "signup", "Setting")]
_RESULTS_SQL = f"""{_E}, fam(family, kind) AS (VALUES {", ".join(f"('{n[3:].split('_')[0]}', '{k}')" for n, k, _ in _FAMILIES)}),
    res AS (SELECT family, CASE WHEN user_id % 2 = 0 THEN 'coarse' ELSE 'fine' END AS protocol, event_id % 9 AS k, CAST(printf('%.4f', avg(CAST(floor(value * 100) AS BIGINT)) / 100000) AS DOUBLE) AS f1
      FROM e JOIN fam ON kind = event_type GROUP BY ALL),
    good AS (SELECT * FROM res WHERE k <> 4),
    best AS (SELECT family, protocol, 's' || k AS setting, f1 AS best FROM good QUALIFY row_number() OVER (PARTITION BY family, protocol ORDER BY f1 DESC, k) = 1)"""


def _results(spark, sf) -> DataFrame:
    """The tables of runs written as CSV files to the shared folder and read back: every fifth setting's F1 is no number."""
    import uuid

    path = f"{scratch.shared_dir(spark)}/results-{uuid.uuid4().hex}"
    scratch.drop_at_exit(spark, path)
    rows = _events(spark, sf).withColumns({"protocol": F.when(F.col("user_id") % 2 == 0, "coarse").otherwise("fine"), "k": F.col("event_id") % 9})
    means = rows.groupBy("event_type", "protocol", "k").agg((F.avg(F.floor(F.col("value") * 100)) / 100000).alias("f1")).cache()
    for name, kind, setting in _FAMILIES:
        for protocol in ("coarse", "fine"):
            own = means.where((F.col("event_type") == kind) & (F.col("protocol") == protocol))
            f1 = F.when(F.col("k") == 4, "n/a, bad").otherwise(X.exact_text(F.col("f1"), 4))
            cells = own.select("k", F.concat(F.lit("s"), "k").alias(setting), F.lit('say "so"').alias(f"Note {kind}"), f1.alias("F1"))
            sinks.write_csv(cells.orderBy("k").drop("k"), f"{path}/{name}_{protocol}.csv", [setting, f"Note {kind}", "F1"])
    means.unpersist()
    return reports.read_tables(spark, path)


@_query(f"""
    WITH {_RESULTS_SQL}
    SELECT family, c.setting AS coarse_setting, c.best AS coarse_best, f.setting AS fine_setting, f.best AS fine_best, round(f.best - c.best, 6) AS delta, coalesce(printf('%+.4f', f.best - c.best), '-') AS shown, coalesce(f.best > c.best, false) AS gain
    FROM (SELECT * FROM best WHERE protocol = 'coarse') c FULL JOIN (SELECT * FROM best WHERE protocol = 'fine') f USING (family)""")
def report_comparison(spark, sf):
    found = reports.compare_protocols(reports.best_rows(_results(spark, sf)))
    return found.select("family", "coarse_setting", "coarse_best", "fine_setting", "fine_best", F.round("delta", 6).alias("delta"), "shown", "gain")


@_query(f"""
    WITH {_RESULTS_SQL}, x AS (SELECT family, protocol, k, CASE WHEN k = 4 THEN 'n/a, bad' ELSE printf('%.4f', f1) END AS v, CASE WHEN k <> 4 THEN f1 END AS f1 FROM res)
    SELECT family, protocol, CAST(row_number() OVER (PARTITION BY family, protocol ORDER BY k) - 1 AS INTEGER) AS "row", v AS "value", coalesce(f1 = max(f1) OVER (PARTITION BY family, protocol), false) AS best FROM x""")
def report_cells(spark, sf):
    """The F1 column of every table, with its best cells marked."""
    return reports.marked_cells(_results(spark, sf)).where("column = 'F1'").select("family", "protocol", "row", "value", "best")


# ---- whole experiments on the events' talk: clicks are edges, views slides, purchases truths

def _talk(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges, cues, slides and truths."""
    rows = _events(spark, sf).select(F.col("user_id").alias("lecture_id"), "event_id", "event_type", "value", (F.col("t") / 600).alias("time"))
    of = lambda kind: rows.where(F.col("event_type") == kind)
    edges = of("click").select("lecture_id", F.col("event_id").alias("left_window_id"), (F.col("event_id") + 1).alias("right_window_id"), F.col("time").alias("left_start"), F.col("time").alias("left_end"), F.col("time").alias("right_start"), (F.col("time") + 5).alias("right_end"), F.col("value").alias("similarity"))
    w = Window.partitionBy("lecture_id").orderBy("time", "event_id")
    truths = of("purchase").select("lecture_id", (F.row_number().over(w) - 1).cast("int").alias("gt_index"), "time", X.hms_nearest(F.col("time")).alias("time_str"), F.concat(F.lit("Part "), "event_id").alias("title"))
    return edges, _speech(spark, sf), of("view").select("lecture_id", "time"), truths


def _space_sql(out: str, src: str, distance: str) -> str:
    """CTEs whose last, ``out`` (k, time), spaces src (k, time, value, id) so that the strongest of a crowd stays; where
    all values are equal, the first does."""
    far = f"o.time - lt >= {distance}"
    return f"""
    {out}_o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY time, value, id) AS rn FROM {src}),
    {out}_r AS (SELECT k, rn, 1 AS n, time AS lt, CAST(value AS DOUBLE) AS lv FROM {out}_o WHERE rn = 1
      UNION ALL SELECT o.k, o.rn, CASE WHEN {far} THEN n + 1 ELSE n END, CASE WHEN {far} OR o.value < lv THEN o.time ELSE lt END, CASE WHEN {far} OR o.value < lv THEN o.value ELSE lv END
      FROM {out}_r r JOIN {out}_o o ON o.k = r.k AND o.rn = r.rn + 1),
    {out} AS (SELECT k, arg_max(lt, rn) AS time FROM {out}_r GROUP BY k, n)"""


_MARKS_SQL = "|".join(p for _, p in X.MARKER_TAGS).replace("'", "''")
_TALK = f"""{_E}, c AS (SELECT user_id, event_id, event_type, value, t / 600 AS t, {_SPEECH_SQL} AS text FROM e),
    mk AS (SELECT user_id AS k, t AS time, 0 AS value, event_id AS id FROM c WHERE regexp_matches(lower(text), '{_MARKS_SQL}')), {_space_sql("marks", "mk", "20")},
    sl AS (SELECT user_id, t, event_id FROM c WHERE event_type = 'view'),
    d AS (SELECT user_id, event_id, t, value, coalesce(value < lag(value) OVER w AND value < lead(value) OVER w, false) AS low, coalesce(least(lag(value) OVER w - value, lead(value) OVER w - value), 0) AS prom
      FROM c WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT user_id, t AS time, 'Part ' || event_id AS title, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS INTEGER) AS gt_index FROM c WHERE event_type = 'purchase')"""
_MARKED = "EXISTS (SELECT 1 FROM marks WHERE marks.k = {0}.user_id AND abs(marks.time - {0}.t) <= {1})"


def _kept_sql(setting: str, where: str, distance: float, table: str = "d", value: str = "value") -> str:
    return f"SELECT '{setting}' || '/' || user_id AS k, {distance}::DOUBLE AS dd, t AS time, CAST({value} AS DOUBLE) AS value, event_id AS id FROM {table} WHERE {where}"


def _scores_sql(kept: list[str], tolerance: float = 30.0, spaced: str | None = None) -> str:
    """CTEs whose last, ``scores``, has the reports of every setting and user; kept: SELECTs by _kept_sql()."""
    names = " UNION ALL ".join(f"SELECT '{n}' AS setting" for n in dict.fromkeys(k.split("'", 2)[1] for k in kept))
    return f"""
    kept AS ({" UNION ALL ".join(kept)}), {_space_sql("sp", "kept", "o.dd")},
    ps AS (SELECT k, time, CAST(row_number() OVER (PARTITION BY k ORDER BY time) - 1 AS INTEGER) AS pred_index FROM sp),
    gs AS (SELECT setting || '/' || user_id AS k, time, gt_index FROM g, ({names}) n),
    {_greedy_sql('ps', 'gs', 'k', tolerance)}, {_prf_sql('m', 'ps', 'gs', 'k')},
    scores AS (SELECT split_part(k, '/', 1) AS setting, CAST(split_part(k, '/', 2) AS BIGINT) AS user_id, pred_count, gt_count, tp, fp, fn, precision, recall, f1 FROM f)"""


_SHOWN = "setting, user_id, pred_count, gt_count, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("setting", F.col("lecture_id").alias("user_id"), "pred_count", "gt_count", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@_query(f"WITH RECURSIVE {_TALK}, {_scores_sql([_kept_sql('threshold', 'value < 60', 0), _kept_sql('minimum', 'value < 60 AND low', 0), _kept_sql('minimum+distance', 'value < 60 AND low', 90)])} SELECT {_SHOWN} FROM scores")
def rule_ablation(spark, sf):
    edges, _, _, truths = _talk(spark, sf)
    return _shown(experiments.rule_ablation(edges, truths, 60.0, 90.0))


@_query(f"WITH RECURSIVE {_TALK}, {_scores_sql([_kept_sql(f'd_d{d}', 'value < 80 AND low', d) for d in (20, 60, 200)])} SELECT {_SHOWN} FROM scores")
def distance_sweep(spark, sf):
    edges, _, _, truths = _talk(spark, sf)
    return _shown(experiments.distance_sweep(edges, truths, [20.0, 60.0, 200.0], 80.0))


@_query(f"WITH RECURSIVE {_TALK}, {_scores_sql([_kept_sql(f'F1_pm{d}_c{c}_md30', f'value < {c} AND low AND ' + _MARKED.format('d', d), 30) for d in (15, 60) for c in (60, 90)])} SELECT {_SHOWN} FROM scores")
def marker_gate_sweep(spark, sf):
    edges, cues, _, truths = _talk(spark, sf)
    return _shown(experiments.gate_sweep(edges, cues, truths, [15.0, 60.0], [60.0, 90.0]))


_LEAST = [0.0, 10.0, 25.0]
_PROMINENT = f"{_TALK}, {_scores_sql([_kept_sql(f'F2_p0{str(p)[:-2] if p else 0}' if not p else f'F2_p{p:g}', f'value < 90 AND low AND prom >= {p} - 1e-12 AND ' + _MARKED.format('d', 60), 30) for p in _LEAST])}"


def _prominence(spark, sf) -> tuple[DataFrame, DataFrame]:
    edges, cues, _, truths = _talk(spark, sf)
    return experiments.prominence_sweep(edges, cues, truths, _LEAST, threshold=90.0, delta=60.0)


@_query(f"WITH RECURSIVE {_PROMINENT} SELECT {_SHOWN} FROM scores")
def prominence_sweep(spark, sf):
    return _shown(_prominence(spark, sf)[0])


@_query(f"WITH RECURSIVE {_PROMINENT}, b AS (SELECT s.setting, s.f1 - coalesce(x.f1, 0) AS dd FROM scores s LEFT JOIN (SELECT * FROM scores WHERE setting = 'F2_p00') x ON x.user_id = s.user_id) SELECT setting, count(*) FILTER (dd > 1e-6) AS improved, count(*) FILTER (dd < -1e-6) AS worse, count(*) FILTER (abs(dd) <= 1e-6) AS unchanged FROM b GROUP BY setting")
def prominence_improvements(spark, sf):
    return _prominence(spark, sf)[1]


_WITH_SLIDES = f"value < 90 AND low AND {_MARKED.format('d', 60)}"
_SLIDES = f"""{_TALK}, {_scores_sql([
    _kept_sql('OR20', _WITH_SLIDES, 30), _kept_sql('OR20', _MARKED.format('sl', 60), 30, 'sl', '1.0'), _kept_sql('OR30', _WITH_SLIDES, 30), _kept_sql('OR30', _MARKED.format('sl', 60), 30, 'sl', '1.0'),
    _kept_sql('AND20', _WITH_SLIDES + ' AND EXISTS (SELECT 1 FROM sl WHERE sl.user_id = d.user_id AND abs(sl.t - d.t) <= 20)', 30)])}"""


def _slides(spark, sf) -> tuple[DataFrame, DataFrame]:
    edges, cues, slides, truths = _talk(spark, sf)
    return experiments.slide_sweep(edges, cues, slides, truths, 0.25, threshold=90.0, delta=60.0)


@_query(f"WITH RECURSIVE {_SLIDES} SELECT {_SHOWN} FROM scores")
def slide_sweep(spark, sf):
    return _shown(_slides(spark, sf)[0])


@_query(f"WITH RECURSIVE {_SLIDES}, a AS (SELECT setting, {_mean_sql('precision')} AS avg_precision, {_mean_sql('recall')} AS avg_recall, {_mean_sql('f1')} AS avg_f1, round(avg(pred_count), 2) AS avg_pred_count, count(*) AS n FROM scores GROUP BY setting) SELECT *, round(avg_f1 - 0.25, 4) AS delta FROM a")
def slide_sweep_deltas(spark, sf):
    return _slides(spark, sf)[1]


_FILLERS_SQL = "len(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x IN (" + ", ".join(f"'{f}'" for f in X.FILLERS) + ")))"
_SIGNALS = f"""
    fc AS (SELECT user_id, event_id, t, {_FILLERS_SQL} AS n FROM c), fs AS (SELECT user_id, event_id, t, sum(n) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS v FROM fc),
    fk AS (SELECT *, v >= coalesce(lag(v) OVER w, v) AND v >= coalesce(lead(v) OVER w, v) AS peak FROM fs WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    fi AS (SELECT user_id AS k, t AS time, 0 AS value, event_id AS id FROM fk WHERE v >= 3 AND peak), {_space_sql("fillers", "fi", "20")},
    si AS (SELECT user_id AS k, t AS time, 0 AS value, event_id AS id FROM sl), {_space_sql("slides", "si", "20")},
    sig AS (SELECT k AS user_id, time AS t, 'marker' AS signal, 0 AS event_id FROM marks UNION ALL SELECT k, time, 'filler', 0 FROM fillers UNION ALL SELECT k, time, 'slide', 0 FROM slides)"""


@_query(f"WITH RECURSIVE {_TALK}, {_SIGNALS}, {_scores_sql([_kept_sql(m.title(), f'signal = {m!r}', 20, 'sig', '0') for m in ('marker', 'filler', 'slide')])} SELECT {_SHOWN} FROM scores")
def fusion_scores(spark, sf):
    """The models of structural signals alone: markers, peaks of fillers, slides."""
    _, cues, slides, truths = _talk(spark, sf)
    return _shown(experiments.signal_fusion(cues, slides, truths))


_ALIGNED = f"""{_TALK}, p AS (SELECT user_id, t AS time, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS INTEGER) AS pred_index FROM d WHERE value < 60), {_greedy_sql('p', 'g', 'user_id', 30.0)}, {_prf_sql('m', 'p', 'g', 'user_id')},
    u AS (SELECT p.* FROM p ANTI JOIN m USING (user_id, pred_index)), fp AS (SELECT u.user_id, u.pred_index, u.time, min(abs(g.time - u.time)) AS dist FROM u LEFT JOIN g ON g.user_id = u.user_id GROUP BY ALL),
    fb AS (SELECT *, CASE WHEN dist <= 30 THEN 'redundant_near_gt' WHEN dist <= 120 THEN 'offset_near_miss' ELSE 'spurious_far' END AS fp_bucket FROM fp)"""


def _talk_preds(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Predictions (clicks of low value), truths, cues and slides."""
    edges, cues, slides, truths = _talk(spark, sf)
    w = Window.partitionBy("lecture_id").orderBy("right_start", "left_window_id")
    preds = edges.where("similarity < 60").select("lecture_id", (F.row_number().over(w) - 1).cast("int").alias("pred_index"), F.col("right_start").alias("time"))
    return preds, truths, cues, slides


_BUCKETS = ("redundant_near_gt", "offset_near_miss", "spurious_far")


@_query(f"""
    WITH RECURSIVE {_ALIGNED}, b AS (SELECT user_id, count(*) AS n, {", ".join(f"count(*) FILTER (fp_bucket = '{x}') AS {x}" for x in _BUCKETS)} FROM fb GROUP BY user_id),
    dens AS (SELECT user_id, avg(n) AS mean_n, max(n) AS max_n FROM (SELECT g.user_id, g.gt_index, count(p.pred_index) AS n FROM g LEFT JOIN p ON p.user_id = g.user_id AND abs(p.time - g.time) <= 30 GROUP BY ALL) GROUP BY user_id)
    SELECT f.user_id, pred_count, gt_count, tp, fp, fn, round(f1, 6) AS f1, {", ".join(f"coalesce({x}, 0) AS {x}, coalesce(round(100 * ({x} / n), 2), 0) AS {x}_pct" for x in _BUCKETS)}, round(mean_n, 6) AS mean_preds_per_gt, max_n AS max_preds_per_gt
    FROM f LEFT JOIN b USING (user_id) LEFT JOIN dens USING (user_id)""")
def alignment_summary(spark, sf):
    preds, truths, _, _ = _talk_preds(spark, sf)
    found = experiments.alignment_summary(preds, truths).withColumnRenamed("lecture_id", "user_id")
    return found.select("user_id", "pred_count", "gt_count", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), *(c for x in _BUCKETS for c in (x, f"{x}_pct")), F.round("mean_preds_per_gt", 6).alias("mean_preds_per_gt"), "max_preds_per_gt")


_HMS_SQL = "printf('%02d:%02d:%02d', CAST(round_even({0}, 0) AS BIGINT) // 3600, CAST(round_even({0}, 0) AS BIGINT) % 3600 // 60, CAST(round_even({0}, 0) AS BIGINT) % 60)"
_TAGS_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(snippet), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in X.MARKER_TAGS) + "], lambda x: x IS NOT NULL), ';')"


@_query(f"""
    WITH RECURSIVE {_ALIGNED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dist DESC NULLS LAST, pred_index) AS rank FROM fb), top AS (SELECT * FROM r WHERE rank <= 3),
    gi AS (SELECT top.user_id, top.pred_index, min({{'d': abs(g.time - top.time), 'i': g.gt_index, 'title': g.title}}) AS b FROM top JOIN g ON g.user_id = top.user_id GROUP BY ALL),
    sn AS (SELECT top.user_id, pred_index, count(*) AS n, string_agg('[' || {_HMS_SQL.format("c.t")} || '–' || {_HMS_SQL.format("(c.t + 5)")} || '] ' || c.text, ' ' ORDER BY c.event_id) AS snippet FROM top JOIN c ON c.user_id = top.user_id AND NOT (c.t + 5 < top.time - 45 OR c.t > top.time + 45) AND c.text <> '' GROUP BY ALL),
    mn AS (SELECT top.user_id, pred_index, min(abs(mk.time - top.time)) AS dm FROM top JOIN mk ON mk.k = top.user_id GROUP BY ALL), sd AS (SELECT top.user_id, pred_index, min(abs(sl.t - top.time)) AS ds FROM top JOIN sl ON sl.user_id = top.user_id GROUP BY ALL),
    a AS (SELECT top.user_id, top.pred_index, CAST(rank AS INTEGER) AS rank, top.time, dist, gi.b.title AS title, coalesce(snippet, '') AS snippet, coalesce(n, 0) AS n, dm, ds FROM top LEFT JOIN gi USING (user_id, pred_index) LEFT JOIN sn USING (user_id, pred_index) LEFT JOIN mn USING (user_id, pred_index) LEFT JOIN sd USING (user_id, pred_index))
    SELECT user_id, pred_index, rank, {_HMS_SQL.format("time")} AS pred_time_hms, title AS nearest_gt_title, round(dist, 4) AS distance, snippet, n AS snippet_block_count,
      CAST({_FILLERS_SQL.replace("text", "snippet")} AS BIGINT) AS filler_hits_in_snippet, {_TAGS_SQL} AS marker_patterns_in_snippet,
      CASE WHEN dm IS NULL THEN 'no' WHEN dm <= 15 THEN printf('yes Δ=%.1fs', dm) ELSE printf('no (nearest %.0fs)', dm) END AS marker_cue_near_pred,
      CASE WHEN ds IS NULL THEN 'no' WHEN ds <= 20 THEN printf('yes Δ=%.1fs', ds) ELSE printf('no (nearest %.0fs)', ds) END AS slide_near_pred FROM a""")
def false_positive_review(spark, sf):
    """The three farthest false positives of each talk with all that a reviewer sees of them."""
    preds, truths, cues, slides = _talk_preds(spark, sf)
    found = experiments.false_positive_review(preds, truths, cues, slides, most=3)
    return found.select(F.col("lecture_id").alias("user_id"), "pred_index", "rank", "pred_time_hms", "nearest_gt_title", F.round("nearest_gt_dist_sec", 4).alias("distance"), "snippet", F.col("snippet_block_count"), F.col("filler_hits_in_snippet").cast("long").alias("filler_hits_in_snippet"), "marker_patterns_in_snippet", "marker_cue_near_pred", "slide_near_pred")


@_query(f"""
    WITH {_E}, {_DRAFT_SQL}, {_MERGE_SQL}, n AS (SELECT user_id, generate_subscripts(xs, 1) AS seg_index, unnest(xs) AS s FROM s6),
    g AS (SELECT user_id, t / 600 AS time, 'Part ' || event_id AS title FROM e WHERE event_type = 'purchase'), ff AS (SELECT user_id, arg_min(title, time) AS title FROM g GROUP BY user_id),
    x AS (SELECT n.user_id, n.seg_index, n.s.time AS time, n.s.label AS label, n.s.topic AS topic, n.s.text AS text FROM n),
    ln AS (SELECT x.*, coalesce(g.title, ff.title, 'Unassigned Section') AS section, trim(regexp_replace(x.text, '[^A-Za-z0-9 ,.''-]', '', 'g')) AS plain FROM x ASOF LEFT JOIN g ON g.user_id = x.user_id AND x.time >= g.time LEFT JOIN ff ON ff.user_id = x.user_id)
    SELECT user_id, CAST(seg_index AS INTEGER) AS seg_index, {_HMS_SQL.format("time")} || chr(9) || printf('S%03d', CAST(seg_index AS INTEGER)) || chr(9) || label || chr(9) || section || ' : ' || topic || chr(9) || CASE WHEN length(plain) > 80 THEN rtrim(plain[:77]) || '...' ELSE plain END AS line FROM ln""")
def draft_lines(spark, sf):
    """Draft annotations of every talk, each under its section, as the lines of their files."""
    _, cues, _, truths = _talk(spark, sf)
    return experiments.draft_boundaries(cues.repartition("lecture_id"), truths, True).withColumnRenamed("lecture_id", "user_id")


@_query(f"""
    WITH {_E}, q AS (SELECT user_id, t / 600 AS t, event_id FROM e WHERE event_type = 'error'), qc AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 30 THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    cl AS (SELECT user_id, avg(t) AS t FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM qc) GROUP BY user_id, c), g AS (SELECT user_id, t / 600 AS time, event_id FROM e WHERE event_type = 'purchase'),
    d AS (SELECT g.user_id, g.event_id, min(abs(cl.t - g.time)) AS d FROM g LEFT JOIN cl ON cl.user_id = g.user_id GROUP BY ALL)
    SELECT user_id, tolerance, count(*) AS gt_count, count(*) FILTER (d <= tolerance) AS hits, round(100 * count(*) FILTER (d <= tolerance) / count(*), 6) AS hit_rate FROM d, (VALUES (5.0::DOUBLE), (10.0), (15.0)) x(tolerance) GROUP BY ALL""")
def silence_check(spark, sf):
    """How many truths have a cluster of silences within each tolerance."""
    _, _, _, truths = _talk(spark, sf)
    silences = _events(spark, sf).where("event_type = 'error'").select(F.col("user_id").alias("lecture_id"), (F.col("t") / 600).alias("time"))
    found = experiments.silence_check(truths, silences, 30.0)
    return found.select(F.col("lecture_id").alias("user_id"), "tolerance", "gt_count", "hits", F.round("hit_rate", 6).alias("hit_rate"))


@_query(f"""
    WITH RECURSIVE {_TALK}, {_scores_sql([_kept_sql('low', 'value < 30', 0), _kept_sql('high', 'value < 60', 0)])}, ga AS (SELECT setting || '/' || user_id AS k, time + 25 AS time, gt_index FROM g, (SELECT 'low' AS setting UNION ALL SELECT 'high') n),
    {_greedy_sql('ps', 'ga', 'k', 30.0, 'm2')}, {_prf_sql('m2', 'ps', 'ga', 'k', 'f2')}
    SELECT split_part(f.k, '/', 1) AS setting, count(*) AS lectures, {", ".join(f"round(avg(f.{c}), 6) AS {c}_orig, round(avg(f2.{c}), 6) AS {c}_corrected, round(avg(f2.{c} - f.{c}), 6) AS delta_{c}" for c in ("precision", "recall", "f1"))}
    FROM f JOIN f2 ON f2.k = f.k GROUP BY 1""")
def truth_versions(spark, sf):
    """Means over talks under two versions of the truth, for two sets of predictions."""
    edges, _, _, truths = _talk(spark, sf)
    preds = [edges.where(F.col("similarity") < v).select(F.lit(n).alias("setting"), "lecture_id", F.col("right_start").alias("time")) for n, v in (("low", 30.0), ("high", 60.0))]
    means = experiments.compare_truths(preds[0].unionByName(preds[1]), truths, truths.withColumn("time", F.col("time") + 25))[1]
    return means.select("setting", "lectures", *(F.round(f"{c}_{v}" if v != "delta" else f"delta_{c}", 6).alias(f"{c}_{v}" if v != "delta" else f"delta_{c}") for c in ("precision", "recall", "f1") for v in ("orig", "corrected", "delta")))


@_query(f"""
    WITH RECURSIVE {_E}, x AS (SELECT DISTINCT user_id AS k, CAST(printf('%.2f', floor(value * 40) / 4) AS DOUBLE) AS time, 0 AS value, 0 AS id FROM e WHERE event_type IN ('view', 'click')), {_space_sql("s", "x", "1.5")}
    SELECT k AS user_id, time, {_HMS_SQL.format("time")} AS line FROM s""")
def slide_changes(spark, sf):
    """Logs of scene changes (several a line, repeated ones) taken apart, made distinct and spaced."""
    said = F.concat(F.lit("n:1 pts_time:"), F.format_string("%.2f", F.floor(F.col("value") * 40) / 4), F.lit(" x"))
    rows = _events(spark, sf).where("event_type IN ('view', 'click')").select("user_id", "event_id", said.alias("said"))
    log = rows.groupBy(F.col("user_id").alias("lecture_id"), (F.col("event_id") % 3).alias("part")).agg(F.array_join(F.collect_list("said"), "\n").alias("value"))
    return experiments.slide_changes(log, 1.5).withColumnRenamed("lecture_id", "user_id")


@_query(r"""
    WITH t AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS k, '<b>' || trim(split_part(text, chr(10), 1)) || '</b>  [x]' AS said FROM conversations),
    v(variant) AS (VALUES ('none'), ('tags'), ('strict')), a AS (SELECT variant, conv_id, k, CASE WHEN k % 3 = 1 THEN '[noise]' ELSE said END AS said FROM t, v),
    b AS (SELECT variant, conv_id, k, CASE variant WHEN 'none' THEN said WHEN 'tags' THEN trim(regexp_replace(regexp_replace(said, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) ELSE trim(regexp_replace(regexp_replace(regexp_replace(said, '<[^>]+>', '', 'g'), '\[(.*?)\]', '', 'g'), '\s+', ' ', 'g')) END AS text FROM a)
    SELECT variant, conv_id, CAST(row_number() OVER (PARTITION BY variant, conv_id ORDER BY k) - 1 AS INTEGER) AS block_id, CAST(k * 60 AS DOUBLE) AS start, text FROM b WHERE variant <> 'strict' OR text <> ''""")
def vtt_variants(spark, sf):
    """The same bodies read raw, without tags, and strictly without empty cues; with notes and clocks of two parts."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    said = F.concat(F.lit("<b>"), F.trim(F.get(F.split("text", "\n"), F.lit(0))), F.lit("</b>  [x]"))
    rows = _table(spark, sf, "conversations").select("conv_id", k.alias("k"), said.alias("said")).withColumn("said", F.when(F.col("k") % 3 == 1, "[noise]").otherwise(F.col("said")))
    cue = F.concat(F.lit("NOTE {} \n\n"), F.format_string("%02d:00,000 --> %02d:30.500", "k", "k"), F.lit("\r\n"), "said")
    files = rows.select("conv_id", "k", cue.alias("cue")).groupBy(F.col("conv_id").alias("lecture_id")).agg(F.concat(F.lit("WEBVTT\n\n"), F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "cue"))), lambda x: x["cue"]), "\n \n"), "\r\n?", "\n")).alias("body"))
    found = [transcripts.cues_of(files, mode, mode == "strict").select(F.lit(mode).alias("variant"), F.col("lecture_id").alias("conv_id"), "block_id", "start", "text") for mode in ("none", "tags", "strict")]
    return found[0].union(found[1]).union(found[2])


@_query(f"""
    WITH {_E}, x AS (SELECT user_id, 'lenient' AS kind, CAST(floor(t) AS BIGINT) % 35999 AS s, event_id FROM e WHERE event_type = 'signup' UNION ALL SELECT user_id, 'coarse', CAST(floor(t) AS BIGINT) % 35999, event_id FROM e WHERE event_type = 'purchase')
    SELECT user_id, kind, CAST(row_number() OVER (PARTITION BY user_id, kind ORDER BY s, event_id) - 1 AS INTEGER) AS gt_index, CAST(s AS DOUBLE) AS time, s // 3600 || printf(':%02d:%02d', s % 3600 // 60, s % 60) AS time_str, 'Title ' || event_id AS title FROM x""")
def truth_variants(spark, sf):
    """Annotations with hours of one digit, out of order, some without a title, and sections with prefixes, read back."""
    rows = _events(spark, sf).where("event_type IN ('signup', 'purchase')").select("user_id", "event_type", "event_id", (F.floor("t") % 35999).alias("s"))
    coarse = F.col("event_type") == "purchase"
    clock = F.concat(F.floor(F.col("s") / 3600).cast("string"), F.format_string(":%02d:%02d", F.floor(F.col("s") % 3600 / 60), F.col("s") % 60))
    line = F.concat(clock, F.lit(" "), F.when(coarse, F.lit("L12: ")).otherwise(""), F.lit("Title "), "event_id", F.lit("  \n0:00:09\n"))
    files = rows.select("user_id", "event_type", "event_id", line.alias("line")).groupBy(F.col("user_id").alias("lecture_id"), "event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "").alias("body"))
    found = [transcripts.boundaries_of(transcripts.lines_of(files.where(F.col("event_type") == kind)), True, kind == "purchase").select(F.col("lecture_id").alias("user_id"), F.lit(name).alias("kind"), "gt_index", "time", "time_str", "title") for kind, name in (("signup", "lenient"), ("purchase", "coarse"))]
    return found[0].union(found[1])


# ---- display names, and tables that are written and read again

_RULES = {"click": "Threshold only", "view": "Threshold + Local minima", "error": "Threshold + Local minima + Min-distance"}


@_query(f"""
    WITH {_E}, c AS (SELECT user_id, event_id, event_type, value, {_SPEECH_SQL} AS text FROM e)
    SELECT event_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in X.MARKER_TAGS)}], lambda x: x IS NOT NULL), ';') AS tags,
      CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RULES.items())} ELSE event_type END AS rule, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RULES.items())} ELSE '-' END AS known,
      CASE WHEN value < 50 THEN '✓' ELSE '×' END AS low, printf('%+.4f', value - 50) AS signed, printf('%.3f', value) AS three, 'lecture' || user_id AS lecture_id,
      array_to_string(list_transform(range(least(event_id % 12, 8)), lambda i: 't' || i), ', ') || CASE WHEN event_id % 12 > 8 THEN ' (+' || (event_id % 12 - 8) || ' more)' ELSE '' END AS preview FROM c""")
def display_names(spark, sf):
    """What reports show of an event: cue tags, names from maps, ticks, signed and fixed numbers, a file's lecture, previews."""
    rows = _events(spark, sf).select("user_id", "event_id", "event_type", "value").join(_speech(spark, sf).select(F.col("block_id").alias("event_id"), "text"), "event_id")
    path = F.concat(F.lit("s3://x/y/lecture"), "user_id", F.lit("_boundaries.txt"))
    n = F.col("event_id") % 12
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.concat(F.lit("t"), i))).otherwise(F.array().cast("array<string>"))
    kind = F.col("event_type")
    return rows.select("event_id", X.cue_tags(F.col("text")).alias("tags"), X.named(kind, _RULES).alias("rule"), X.named(kind, _RULES, "-").alias("known"), X.tick(F.col("value") < 50).alias("low"), X.signed(F.col("value") - 50).alias("signed"), X.exact_text(F.col("value"), 3).alias("three"), X.file_stem(path, "_boundaries").alias("lecture_id"), sinks.preview(items).alias("preview"))


def _place(spark, name: str) -> str:
    import uuid

    path = f"{scratch.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scratch.drop_at_exit(spark, path)
    return path


@_query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_fallback(spark, sf):
    """A table written as CSV in a folder of snapshots, found there as the first place has none."""
    path = _place(spark, "tables")
    sinks.write_csv(_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), f"{path}/old/t.csv", ["c_custkey", "c_name", "c_acctbal"])
    return transcripts.read_csv(spark, "c_custkey long, c_name string, c_acctbal double", f"{path}/t.csv", f"{path}/old/t.csv")


@_query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, len(embedding) AS dim FROM embeddings")
def vector_table(spark, sf):
    """Vectors written as an array column and read again."""
    path = _place(spark, "vectors")
    sinks.write_vectors(_table(spark, sf, "embeddings"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", "label", F.round(total, 6).alias("total"), F.size("embedding").cast("long").alias("dim"))


@_query(f"""
    WITH {_E}, m AS (SELECT user_id, event_type, count(*) AS tp, {_HMS_SQL.format("min(t) % 86400")} AS first_hms FROM e GROUP BY ALL)
    SELECT 'lecture' || user_id AS lecture_id, event_type AS setting, tp, first_hms FROM m""")
def json_summaries(spark, sf):
    """Summaries written as JSON under a folder for each setting, found at any depth, with the setting from the path."""
    path = _place(spark, "summaries")
    rows = _events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("tp"), F.min("t").alias("t"))
    shaped = rows.select(F.concat(F.lit("lecture"), "user_id").alias("lecture_id"), F.col("event_type").alias("setting"), "tp", X.hms_nearest(F.col("t") % 86400).alias("first_hms"))
    for kind in [r[0] for r in shaped.select("setting").distinct().orderBy("setting").collect()]:  # a handful of names
        sinks.write_json(shaped.where(F.col("setting") == kind).drop("setting"), f"{path}/{kind}/evaluation_summary")
    found = spark.read.schema("lecture_id string, tp long, first_hms string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return found.select("lecture_id", F.regexp_extract("_metadata.file_path", r"([^/]+)/evaluation_summary/[^/]+$", 1).alias("setting"), "tp", "first_hms")


@_query(f"""
    WITH RECURSIVE {_TALK}, mc AS (SELECT user_id, count(*) AS n FROM c WHERE regexp_matches(lower(text), '{_MARKS_SQL}') GROUP BY 1), sp AS (SELECT k AS user_id, count(*) AS n FROM marks GROUP BY 1),
    raw AS (SELECT user_id, count(*) FILTER (value < 90 AND low) AS n, count(*) FILTER (value < 90 AND low AND {_MARKED.format("d", 60)}) AS kept FROM d GROUP BY 1)
    SELECT u.user_id, coalesce(mc.n, 0) AS markers, coalesce(sp.n, 0) AS markers_spaced, coalesce(raw.n, 0) AS dips, coalesce(raw.kept, 0) AS dips_gated
    FROM (SELECT DISTINCT user_id FROM (SELECT user_id FROM mc UNION ALL SELECT user_id FROM raw WHERE n > 0)) u LEFT JOIN mc USING (user_id) LEFT JOIN sp USING (user_id) LEFT JOIN raw USING (user_id)""")
def gate_counts(spark, sf):
    """How many rows each stage of marker gating leaves."""
    edges, cues, _, _ = _talk(spark, sf)
    marks = signals.marker_times(cues)
    spaced = experiments.marks_of(cues)
    found = signals.dips(edges, 90.0)
    stages = {"markers": marks, "markers_spaced": spaced, "dips": found, "dips_gated": J.gate(found, spaced, 60.0, "marker_gated_semantic")}
    return experiments.stage_counts(stages).withColumnRenamed("lecture_id", "user_id")
