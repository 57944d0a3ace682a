"""Decision, retrieval and fusion queries (T, R, U) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.layout import KEY
from seqloom.operators import decisions, fusion, resampling, retrieval, scoring
from seqloom.session import place_by_rows
from seqloom.sources import documents
from seqloom.suite import evidence
from seqloom.suite.fixture import BOTH, LONG_SQL, counts_sql, r, round_all, seq, six_sql, sql, table, wp_sql

Q: dict = {}
SCORED = "need_prediction AND is_scored"


def query(name, text=None):
    def add(fn):
        Q[name] = (fn, text)
        return fn
    return add


# ---- ledger built from orders ----------------------------------------------------------------

LEDGER = """led AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 4 END AS parent_id, o_custkey % 40 AS branch,
  o_totalprice / 500000.0::DOUBLE AS metric, o_orderstatus = 'F' AS buggy,
  CASE o_orderkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'debug' WHEN 2 THEN 'improve' ELSE 'evolution' END AS stage, o_orderpriority AS kind, o_orderstatus AS status FROM orders)"""


def ledger_frame(s, d):
    k = F.col("o_orderkey")
    stage = F.when(k % 4 == 0, "draft").when(k % 4 == 1, "debug").when(k % 4 == 2, "improve").otherwise("evolution")
    return table(s, d, "orders").select(
        k.alias("run_id"), F.when(k % 4 != 0, k - k % 4).alias("parent_id"), (F.col("o_custkey") % 40).alias("branch"),
        (F.col("o_totalprice") / 500000.0).alias("metric"), (F.col("o_orderstatus") == "F").alias("buggy"), stage.alias("stage"),
        F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"))


@query("t01_sort_ranked", f"WITH {LEDGER} SELECT run_id, {r('metric')} AS metric FROM led ORDER BY metric DESC, run_id")
def t01(s, d):
    return round_all(decisions.sort_ranked(ledger_frame(s, d).select("run_id", "metric"), "metric", "run_id"))


@query("t02_top_k_with_group_cap", f"""WITH {LEDGER} SELECT run_id, branch, {r('metric')} AS metric, row_number() OVER (ORDER BY metric DESC, run_id) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY branch ORDER BY metric DESC, run_id) AS g FROM led WHERE NOT buggy) WHERE g <= 2 ORDER BY metric DESC, run_id LIMIT 20""")
def t02(s, d):
    out = decisions.top_k_with_group_cap(ledger_frame(s, d).filter("NOT buggy"), "metric", "run_id", "branch", 20, 2)
    return round_all(out.select("run_id", "branch", "metric", F.col("rank").cast("bigint").alias("rank")))


@query("t03_best_so_far", f"WITH {LEDGER} SELECT run_id, branch, {r('max(metric) OVER (PARTITION BY branch ORDER BY run_id)')} AS best FROM led")
def t03(s, d):
    out = decisions.best_so_far(ledger_frame(s, d), "branch", "run_id", "metric", block=4_096)
    return round_all(out.select("run_id", "branch", "best"))


@query("t04_deltas_vs_reference", f"""WITH {LEDGER} SELECT a.run_id, {r('a.metric - b.metric')} AS delta_parent, {r('a.metric - (SELECT metric FROM led WHERE run_id = 0)')} AS delta_root
FROM led a LEFT JOIN led b ON a.parent_id = b.run_id""")
def t04(s, d):
    led = ledger_frame(s, d)
    out = decisions.deltas_vs_reference(led, "run_id", "parent_id", "metric", led.filter("run_id = 0"))
    return round_all(out.select("run_id", "delta_parent", "delta_root"))


@query("t05_duplicate_runs", """SELECT sha256('o_custkey=' || o_custkey || '|o_orderpriority=' || o_orderpriority) AS signature, count(*) AS runs, min(o_orderkey) AS first_run
FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1""")
def t05(s, d):
    return decisions.duplicate_runs(table(s, d, "orders"), "o_orderkey", ["o_orderpriority", "o_custkey"])


@query("t06_latest_status", f"WITH {LEDGER} SELECT branch, arg_max(kind, run_id) AS status, max(run_id) AS last_event, count(*) AS events FROM led GROUP BY branch")
def t06(s, d):
    return decisions.latest_status(ledger_frame(s, d), "branch", "run_id", "kind")


QUAL = """cand AS (SELECT o_orderkey AS id, (o_totalprice - 250000) / 1e8::DOUBLE AS delta, (o_totalprice - 300000) / 1e8::DOUBLE AS lower, (o_orderkey % 11 - 4) / 10000.0::DOUBLE AS d0,
  (o_orderkey % 13 - 4) / 10000.0::DOUBLE AS d1, (o_orderkey % 100)::DOUBLE AS cost FROM orders)"""


@query("t07_qualify", f"""WITH {QUAL} SELECT id, len(x) = 0 AS qualified, array_to_string(x, ',') AS reasons FROM (SELECT id, list_sort(list_filter([
CASE WHEN NOT delta >= 0.0002 THEN 'delta' END, CASE WHEN NOT lower > 0 THEN 'interval' END, CASE WHEN NOT cost <= 77 THEN 'cost' END,
CASE WHEN NOT d0 >= -0.0002 THEN 'target_d0' END, CASE WHEN NOT d1 >= -0.0002 THEN 'target_d1' END], lambda v: v IS NOT NULL)) AS x FROM cand)""")
def t07(s, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    cand = table(s, d, "orders").select(k.alias("id"), ((p - 250000) / 1e8).alias("delta"), ((p - 300000) / 1e8).alias("lower"),
                                        ((k % 11 - 4) / 10000.0).alias("d0"), ((k % 13 - 4) / 10000.0).alias("d1"), (k % 100).cast("double").alias("cost"))
    out = decisions.qualify(cand, "delta", "lower", ["d0", "d1"], "cost", 77.0)
    return out.select("id", "qualified", F.array_join("reasons", ",").alias("reasons"))


@query("t09_eligible_history", f"WITH {LEDGER} SELECT run_id, {r('metric')} AS metric FROM led WHERE status = 'O' AND metric >= 0.5")
def t09(s, d):
    return round_all(decisions.eligible_history(ledger_frame(s, d), "status", "metric", 0.5, "O").select("run_id", "metric"))


HALVES = [
    LONG_SQL, f"ms AS (SELECT seq_ix % 2 AS half, population, system, target, {six_sql('y', 'p')} FROM (SELECT *, 'uniform' AS population FROM long WHERE need_prediction UNION ALL SELECT *, 'official' FROM long WHERE {SCORED}) GROUP BY ALL)",
    f"mv AS (SELECT a.half, a.population, a.target, {wp_sql('a.')} - {wp_sql('b.')} AS v FROM ms a JOIN ms b USING (half, population, target) WHERE a.system = 'candidate' AND b.system = 'base')",
]


@query("t10_replication_gate", sql(f"SELECT target, bool_and(v > -0.05) AS passed, {r('min(v)')} AS worst, count(*) AS checks FROM mv GROUP BY target", *HALVES))
def t10(s, d):
    pops = F.when(F.col("is_scored"), F.array(F.lit("uniform"), F.lit("official"))).otherwise(F.array(F.lit("uniform")))
    rows = scoring.required_rows(seq(s, d)).withColumn("population", F.explode(pops))
    m = scoring.with_wp(scoring.moments(rows, BOTH, by=[(F.col(KEY) % 2).alias("half"), "population"]))
    v = resampling.contrast_values(m, resampling.DELTA, ["half", "population"]).filter("target <> 'combined'")
    return round_all(decisions.replication_gate(v, ["target"], "value", -0.05))


def audit_ctes():
    sums = scoring.SUMS
    return [
        LONG_SQL,
        f"ls AS (SELECT seq_ix, population, system, target, {six_sql('y', 'p')} FROM (SELECT *, 'uniform' AS population FROM long WHERE need_prediction UNION ALL SELECT *, 'official' FROM long WHERE {SCORED}) GROUP BY ALL)",
        f"sel AS (SELECT population, system, avg(v) AS wp FROM (SELECT population, system, target, {wp_sql()} AS v FROM (SELECT population, system, target, {', '.join(f'sum({m}) AS {m}' for m in sums)} FROM ls WHERE seq_ix % 2 = 0 GROUP BY ALL)) GROUP BY ALL)",
        "ids AS (SELECT seq_ix, row_number() OVER (ORDER BY substr(md5(seq_ix::VARCHAR), 1, 3), seq_ix) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT seq_ix FROM ls WHERE seq_ix % 2 = 1))",
        counts_sql(41, 60),
        f"dm AS (SELECT draw, population, system, target, {', '.join(f'sum(times * {m}) AS {m}' for m in sums)} FROM cnt JOIN ls USING (seq_ix) GROUP BY ALL)",
        f"dw AS (SELECT draw, population, system, avg({wp_sql()}) AS wp FROM dm GROUP BY ALL)",
        "dd AS (SELECT a.population, a.system, quantile_cont(a.wp - b.wp, 0.005) AS lower, quantile_cont(a.wp - b.wp, 0.995) AS upper FROM dw a JOIN dw b USING (draw, population) WHERE a.system = 'candidate' AND b.system = 'base' GROUP BY ALL)",
        f"am AS (SELECT population, system, avg(v) AS wp FROM (SELECT population, system, target, {wp_sql()} AS v FROM (SELECT population, system, target, {', '.join(f'sum({m}) AS {m}' for m in sums)} FROM ls WHERE seq_ix % 2 = 1 GROUP BY ALL)) GROUP BY ALL)",
        "ad AS (SELECT a.population, a.system, a.wp - b.wp AS audit_delta FROM am a JOIN am b USING (population) WHERE a.system = 'candidate' AND b.system = 'base')",
    ]


@query("t11_prospective_selection", sql(
    f"""SELECT population, system, {r('wp')} AS selection_wp, {r('audit_delta')} AS audit_delta, {r('lower')} AS lower, {r('upper')} AS upper,
    row_number() OVER (PARTITION BY population ORDER BY wp DESC, system) = 1 AS selected FROM sel LEFT JOIN ad USING (population, system) LEFT JOIN dd USING (population, system)""", *audit_ctes()))
def t11(s, d):
    pops = F.when(F.col("is_scored"), F.array(F.lit("uniform"), F.lit("official"))).otherwise(F.array(F.lit("uniform")))
    rows = scoring.required_rows(seq(s, d)).withColumn("population", F.explode(pops))
    m = scoring.moments(rows, BOTH, by=[KEY, "population"])
    out = decisions.prospective_selection(m.filter(F.col(KEY) % 2 == 0), m.filter(F.col(KEY) % 2 == 1), "base", 60, 41)
    return round_all(out)


@query("t12_compare_models", sql(
    f"""SELECT 'delta' AS contrast, target, {r('max(pe.v)')} AS point, {r('quantile_cont(de.v, 0.025)')} AS lower, {r('quantile_cont(de.v, 0.975)')} AS upper
    FROM de JOIN pe USING (target) GROUP BY target""", *evidence.drawn(3, 200)))
def t12(s, d):
    m = scoring.moments(scoring.scored_rows(seq(s, d)), BOTH, by=[KEY])
    parts = [m.filter(F.col(KEY) % 3 == k) for k in range(3)]
    return round_all(decisions.compare_models(parts, 200, 3, resampling.DELTA))


@query("t13_outcome_label", f"""WITH {LEDGER} SELECT a.run_id, (CASE WHEN a.stage = 'draft' THEN 1 WHEN a.stage = 'debug' THEN CASE WHEN b.buggy AND NOT a.buggy THEN 1 ELSE -1 END
ELSE coalesce(sign(a.metric - b.metric), 0) END)::INT AS label FROM led a LEFT JOIN led b ON a.parent_id = b.run_id""")
def t13(s, d):
    return decisions.outcome_label(ledger_frame(s, d), "run_id", "parent_id", "stage", "buggy", "metric").select("run_id", "label")


@query("t14_patience", f"""WITH {LEDGER}, b AS (SELECT branch, arg_max(run_id, (metric, -run_id)) AS o, max(metric) AS m FROM led WHERE NOT buggy GROUP BY branch)
SELECT branch, sum((run_id > o AND NOT buggy)::INT)::BIGINT AS success_patience, sum((run_id > o)::INT)::BIGINT AS total_patience, {r('max(m)')} AS best FROM led JOIN b USING (branch) GROUP BY branch""")
def t14(s, d):
    return round_all(decisions.patience(ledger_frame(s, d), "branch", "run_id", "buggy", "metric"))


@query("t15_extreme_metric_flag", f"WITH {LEDGER} SELECT run_id, {r('metric')} AS metric FROM led WHERE metric >= 0.99")
def t15(s, d):
    return round_all(decisions.extreme_metric(ledger_frame(s, d), "metric", True, high=0.99).select("run_id", "metric"))


# ---- retrieval -------------------------------------------------------------------------------

TOK = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1)"
QUERIES_TEXT = {"q1": (["tionen", "ensch", "esing"], ["the", "ingor"]), "q2": (["outre", "queque", "eauou"], [])}


def words():
    return retrieval.tokens(F.col("text"))


@query("r01_tokenize", f"SELECT doc_id, len({TOK}) AS n, md5(array_to_string(list_transform({TOK}, lambda t: CASE t WHEN 'on' THEN 'off' WHEN 'er' THEN 'he' ELSE t END), ' ')) AS digest FROM documents")
def r01(s, d):
    t = retrieval.tokens(F.col("text"), {"on": "off", "er": "he"})
    return table(s, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


BM_VALUES = ", ".join(f"('{q}', '{t}', {w}::DOUBLE)" for q, (a, b) in QUERIES_TEXT.items() for t, w in [*[(t, 1.0) for t in a], *[(t, 0.5) for t in b]])
BM25_CTES = f"""tk AS (SELECT doc_id, {TOK} AS t FROM documents), ln AS (SELECT doc_id, len(t) AS dl FROM tk), av AS (SELECT count(*) AS n, avg(dl) AS a FROM ln),
ql(query, term, w) AS (VALUES {BM_VALUES}), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) WHERE term IN (SELECT term FROM ql) GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, doc_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM tf JOIN ql USING (term) JOIN dfq USING (term) JOIN ln USING (doc_id), av GROUP BY ALL)"""


@query("r02_bm25", f"WITH {BM25_CTES} SELECT query, doc_id, {r('score')} AS score FROM bm")
def r02(s, d):
    return round_all(retrieval.bm25(table(s, d, "documents"), "doc_id", words(), QUERIES_TEXT))


def query_vectors(s, d):
    rows = table(s, d, "embeddings").filter(F.col("vec_id").isin(3, 77)).select("vec_id", "embedding").collect()
    return {f"v{row['vec_id']}": row["embedding"] for row in rows}


KNN = """kq AS (SELECT 'v' || vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (3, 77)),
kd AS (SELECT query, vec_id, list_distance(embedding::DOUBLE[], q) * list_distance(embedding::DOUBLE[], q) AS distance2 FROM embeddings, kq),
kn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance2, vec_id) AS rank FROM kd)"""


@query("r04_vector_knn", f"WITH {KNN} SELECT query, vec_id, {r('distance2')} AS distance2, rank FROM kn WHERE rank <= 10")
def r04(s, d):
    out = retrieval.vector_knn(table(s, d, "embeddings"), "vec_id", "embedding", query_vectors(s, d), 10)
    return round_all(out.withColumn("rank", F.col("rank").cast("bigint")))


HYBRID = f"""{BM25_CTES}, {KNN.replace("'v' || vec_id", "CASE vec_id WHEN 3 THEN 'q1' ELSE 'q2' END")},
b50 AS (SELECT * FROM (SELECT query, doc_id AS id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm) WHERE rank <= 50),
v50 AS (SELECT query, vec_id AS id, rank FROM kn WHERE rank <= 50),
fu AS (SELECT query, id, coalesce(0.5 / (60 + b.rank), 0) + coalesce(0.5 / (60 + v.rank), 0) AS score FROM b50 b FULL OUTER JOIN v50 v USING (query, id))"""


def hybrid_lists(s, d):
    text = retrieval.bm25(table(s, d, "documents").withColumnRenamed("doc_id", "id"), "id", words(), QUERIES_TEXT).withColumn("score", F.round("score", 9))
    v = query_vectors(s, d)
    near = retrieval.vector_knn(table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), "id", "embedding", {"q1": v["v3"], "q2": v["v77"]}, 50)
    return text, near


@query("r05_rrf_fusion", f"WITH {HYBRID} SELECT query, id, {r('score', 9)} AS score FROM fu")
def r05(s, d):
    text, near = hybrid_lists(s, d)
    return round_all(retrieval.rrf_fusion(retrieval.top_k(text, "query", "id", 50), near, "id"), digits=9)


@query("r06_hybrid_search", f"WITH {HYBRID} SELECT query, id, {r('score', 9)} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM fu) WHERE rank <= 10")
def r06(s, d):
    text, near = hybrid_lists(s, d)
    return round_all(retrieval.hybrid_search(text, near, "id").withColumn("rank", F.col("rank").cast("bigint")), digits=9)


@query("r07_near_duplicate_titles", f"""WITH ts AS (SELECT doc_id, list_sort(list_distinct({TOK})) AS st FROM documents), gr AS (SELECT st, min(doc_id) AS id, count(*) AS copies FROM ts WHERE len(st) > 0 GROUP BY st),
tt AS (SELECT id, unnest(st) AS t FROM gr), pc AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM tt a JOIN tt b ON a.t = b.t AND a.id <> b.id GROUP BY ALL),
nd AS (SELECT DISTINCT a AS id FROM pc JOIN gr x ON x.id = a JOIN gr y ON y.id = b WHERE c / (len(x.st) + len(y.st) - c) >= 0.85)
SELECT gr.id, copies, nd.id IS NOT NULL AS near FROM gr LEFT JOIN nd ON nd.id = gr.id WHERE copies > 1 OR nd.id IS NOT NULL""")
def r07(s, d):
    out = retrieval.near_duplicate_titles(table(s, d, "documents"), "doc_id", words())
    return out.select("id", "copies", F.col("partner").isNotNull().alias("near"))


@query("r08_duplicate_sources", """SELECT field, value, count(*) AS uses FROM (SELECT 'url' AS field, url AS value FROM pages UNION ALL SELECT 'page_id', page_id::VARCHAR FROM pages) GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'text_md5', md5(text), count(*) FROM documents GROUP BY 2 HAVING count(*) > 1""")
def r08(s, d):
    docs = table(s, d, "documents").select(F.md5("text").alias("text_md5"))
    return documents.duplicate_sources(table(s, d, "pages"), ["url", "page_id"]).unionByName(documents.duplicate_sources(docs, ["text_md5"]))


@query("r09_forbidden_terms", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'esing|api_key|@') THEN '(omitted)' ELSE text END AS text FROM documents")
def r09(s, d):
    return retrieval.forbidden_terms(table(s, d, "documents").select("doc_id", "text"), "text", "esing|api_key|@", "(omitted)")


@query("r10_filtered_search", f"""WITH {BM25_CTES}, f AS (SELECT query, doc_id, round(score, 9) AS score FROM bm JOIN documents USING (doc_id) WHERE lang = 'en')
SELECT 'similar' AS mode, query, doc_id, {r('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM f WHERE score >= 1) WHERE rank <= 5
UNION ALL SELECT 'dissimilar', query, doc_id, {r('score')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, doc_id) AS rank FROM f) WHERE rank <= 5""")
def r10(s, d):
    docs = table(s, d, "documents")
    text = retrieval.bm25(docs, "doc_id", words(), QUERIES_TEXT).select("query", "doc_id", F.round("score", 9).alias("score"), F.lit(0).alias("rank"))
    parts = [retrieval.filtered_search(text, docs, "doc_id", F.col("lang") == "en", 5, flip, 1.0).select(F.lit(mode).alias("mode"), "query", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))
             for mode, flip in (("similar", False), ("dissimilar", True))]
    return round_all(parts[0].unionByName(parts[1]))


# ---- prediction fusion -------------------------------------------------------------------------

ITEMS = "it AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_quantity) AS q, min(l_discount) AS dc, min(l_partkey) AS pk, min(l_returnflag) AS f FROM lineitem GROUP BY 1)"
MODELS = [("m0", 0, 0.8, True), ("m1", 1, 0.7, True), ("m2", 2, 0.5, True), ("m3", 3, 0.4, True), ("m4", 4, 0.3, True)]
MODEL_SQL = "mo(model, rank, metric, maximize) AS (VALUES " + ", ".join(f"('{m}', {k}, {v}::DOUBLE, {str(x).lower()})" for m, k, v, x in MODELS) + ")"
WEIGHT_SQL = "we AS (SELECT model, rank, metric * (5 - rank) / sum(metric * (5 - rank)) OVER () AS weight FROM mo)"


def items(s, d):
    li = table(s, d, "lineitem")
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", "l_partkey", "l_returnflag")
    # The files know their number of rows.
    return place_by_rows(rows, li.count(), "id").groupBy("id").agg(
        F.min("l_quantity").alias("q"), F.min("l_discount").alias("dc"), F.min("l_partkey").alias("pk"), F.min("l_returnflag").alias("f"))


def models(s):
    return s.createDataFrame(MODELS, "model string, rank int, metric double, maximize boolean")


def predictions(s, d, value):
    """Long predictions; `value(k)` is the column of model k."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), value(k).alias("value")) for m, k, _, _ in MODELS])
    return items(s, d).select("id", F.explode(cells).alias("_c")).select("_c.model", "id", "_c.value")


def pred_sql(expr):
    return "pr AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, id, {expr.format(k=k)} AS value FROM it" for m, k, _, _ in MODELS) + ")"


NUM_SQL = pred_sql("q / 50.0::DOUBLE + {k} * dc")


def number(k):
    return F.col("q") / 50.0 + F.col("dc") * k


def _format_sql(columns: dict, kind: str) -> str:
    """Format of the table `id, columns...`: ids by distinct share, long text by mean length; `kind` gives strategy and normalization."""
    def listing(test):
        return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN avg(length(CAST({e} AS VARCHAR))) {test} {fusion.LONG_TEXT} THEN '{c}' END" for c, e in columns.items()) + "], lambda x: x IS NOT NULL), ',')"
    return (f"SELECT '{kind}' AS source, CASE WHEN count(DISTINCT id) > {fusion.ID_UNIQUE} * count(*) THEN 'id' ELSE '' END AS id_columns, {listing('<=')} AS prediction_columns, "
            f"{listing('>')} AS passthrough_columns, ")


WIDE = "max(CASE WHEN abs(dc / 2 + (1.0 - dc / 2)) > 1e-10 THEN abs(dc / 2 + (1.0 - dc / 2) - 1.0) END) < 0.05"
CELLS = "q || ' ' || dc"
TEXT = "f || ' of ' || pk"


@query("u01_detect_format", f"""WITH {ITEMS},
  averaged AS ({_format_sql({"note": "repeat('long text ', 30)", "a": "dc / 2", "b": "1.0 - dc / 2"}, "average")} CASE WHEN bool_and(dc / 2 = round(dc / 2)) THEN 'vote' ELSE 'average' END AS fusion, {WIDE} AS normalize FROM it),
  voted AS ({_format_sql({"a": "pk"}, "vote")} CASE WHEN bool_and(pk = round(pk)) THEN 'vote' ELSE 'average' END AS fusion, false AS normalize FROM it),
  celled AS ({_format_sql({"a": CELLS}, "cells")} CASE WHEN bool_and(try_cast(string_split({CELLS}, ' ')[1] AS DOUBLE) IS NOT NULL) AND min(len(string_split({CELLS}, ' '))) = max(len(string_split({CELLS}, ' '))) THEN 'cellwise' ELSE 'text_vote' END AS fusion, false AS normalize FROM it),
  worded AS ({_format_sql({"a": TEXT}, "text")} CASE WHEN bool_and(try_cast(string_split({TEXT}, ' ')[1] AS DOUBLE) IS NOT NULL) THEN 'cellwise' ELSE 'text_vote' END AS fusion, false AS normalize FROM it)
  SELECT * FROM averaged UNION ALL SELECT * FROM voted UNION ALL SELECT * FROM celled UNION ALL SELECT * FROM worded""")
def u01(s, d):
    it = items(s, d)
    half = F.col("dc") / 2
    tables = {"average": it.select("id", F.repeat(F.lit("long text "), 30).alias("note"), half.alias("a"), (F.lit(1.0) - half).alias("b")), "vote": it.select("id", F.col("pk").alias("a")),
              "cells": it.select("id", F.concat_ws(" ", "q", "dc").alias("a")), "text": it.select("id", F.concat_ws(" of ", "f", F.col("pk").cast("string")).alias("a"))}
    out = None
    for name, df in tables.items():
        part = fusion.detect_format(df).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("u02_fusion_weights", f"""WITH su AS (SELECT s_nationkey AS nation, s_suppkey AS model, s_acctbal::DOUBLE / 10000.0 + 1.0 AS metric, s_suppkey % 3 <> 0 AS maximize,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS rank FROM supplier),
  sr AS (SELECT *, (CASE WHEN maximize THEN metric ELSE 1.0 / (metric + {fusion.METRIC_EPS}::DOUBLE) END) * (count(*) OVER (PARTITION BY nation) - rank) AS raw FROM su)
  SELECT nation, model, rank::INT AS rank, {r('raw / sum(raw) OVER (PARTITION BY nation)', 9)} AS weight FROM sr""")
def u02(s, d):
    # Suppliers stand for the models of their nation, balances for their metrics.
    place = F.row_number().over(Window.partitionBy("nation").orderBy(F.col("s_acctbal").desc(), "model")) - 1
    su = table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("model"), "s_acctbal")
    su = su.select("nation", "model", (F.col("s_acctbal").cast("double") / 10000.0 + 1.0).alias("metric"), (F.col("model") % 3 != 0).alias("maximize"), place.alias("rank"))
    return round_all(fusion.fusion_weights(su, ["nation"]).select("nation", "model", "rank", "weight"), digits=9)


@query("u03_fuse_average", f"WITH {ITEMS}, {MODEL_SQL}, {WEIGHT_SQL}, {NUM_SQL} SELECT id, {r('sum(weight * value) / sum(weight)')} AS value FROM pr JOIN we USING (model) GROUP BY id")
def u03(s, d):
    return round_all(fusion.fuse_average(predictions(s, d, number), fusion.fusion_weights(models(s))))


VOTE_TAIL = """vt AS (SELECT id, value, round(sum(weight), 12) AS v, min(rank) AS rk FROM pr JOIN we USING (model) GROUP BY ALL)
SELECT id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, rk) AS k FROM vt) WHERE k = 1"""


@query("u04_fuse_vote", f"WITH {ITEMS}, {MODEL_SQL}, {WEIGHT_SQL}, {pred_sql('((pk + {k} * (pk % 4)) % 3)::VARCHAR')}, {VOTE_TAIL}")
def u04(s, d):
    return fusion.fuse_vote(predictions(s, d, lambda k: ((F.col("pk") + k * (F.col("pk") % 4)) % 3).cast("string")), fusion.fusion_weights(models(s)))


TEXT_SQL = pred_sql("trim(coalesce(CASE WHEN (pk + {k}) % 5 = 0 THEN NULL WHEN (pk + {k}) % 2 = 0 THEN ' ' || f ELSE 'none' END, ''))")


@query("u04_fuse_text_vote", f"WITH {ITEMS}, {MODEL_SQL}, {WEIGHT_SQL}, {TEXT_SQL}, {VOTE_TAIL}")
def u04b(s, d):
    def value(k):
        m = F.col("pk") + k
        return F.when(m % 5 == 0, F.lit(None)).when(m % 2 == 0, F.concat(F.lit(" "), F.col("f"))).otherwise(F.lit("none"))
    return fusion.fuse_vote(predictions(s, d, value), fusion.fusion_weights(models(s)), text=True)


CELL_SQL = pred_sql("(pk % 3)::VARCHAR || ' ' || ((pk + {k}) % 2)::VARCHAR || ' ' || ((pk * {k}) % 3)::VARCHAR || CASE WHEN (pk + {k}) % 7 = 0 THEN ' 9' ELSE '' END")


@query("u05_fuse_cellwise", f"""WITH {ITEMS}, {MODEL_SQL}, {WEIGHT_SQL}, {CELL_SQL}, ce AS (SELECT id, weight, rank, unnest(string_split(value, ' ')) AS token, generate_subscripts(string_split(value, ' '), 1) AS pos FROM pr JOIN we USING (model)),
vt AS (SELECT id, pos, token, round(sum(weight), 12) AS v, min(rank) AS rk FROM ce GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY v DESC, rk) AS k FROM vt)
SELECT id, string_agg(token, ' ' ORDER BY pos) AS value FROM w WHERE k = 1 GROUP BY id""")
def u05(s, d):
    def value(k):
        pk = F.col("pk")
        tail = F.when((pk + k) % 7 == 0, F.lit(" 9")).otherwise(F.lit(""))
        return F.concat((pk % 3).cast("string"), F.lit(" "), ((pk + k) % 2).cast("string"), F.lit(" "), ((pk * k) % 3).cast("string"), tail)
    return fusion.fuse_cellwise(predictions(s, d, value), fusion.fusion_weights(models(s)))


@query("u06_row_normalize", f"WITH {ITEMS} SELECT id, {r('CASE WHEN dc + q > 1e-10 THEN dc / (dc + q) ELSE dc END', 9)} AS a, {r('CASE WHEN dc + q > 1e-10 THEN q / (dc + q) ELSE q END', 9)} AS b FROM it")
def u06(s, d):
    return round_all(fusion.row_normalize(items(s, d).select("id", F.col("dc").alias("a"), F.col("q").alias("b")), ["a", "b"]), digits=9)


@query("u07_ensemble_sweep", f"""WITH {ITEMS}, {MODEL_SQL}, {NUM_SQL}, sz AS (SELECT unnest([1, 2, 3, 4]) AS size),
ws AS (SELECT size, model, metric * (size - rank) AS w FROM mo, sz WHERE rank < size)
SELECT size, id, {r('sum(w * value) / sum(w)')} AS value FROM pr JOIN ws USING (model) GROUP BY ALL""")
def u07(s, d):
    return round_all(fusion.ensemble_sweep(predictions(s, d, number), models(s)))


@query("u08_content_quality", f"""WITH {ITEMS}, c AS (SELECT 'f' AS "column", f AS v FROM it UNION ALL SELECT 'blank', CASE WHEN pk % 50 = 0 THEN 'x' ELSE ' ' END FROM it
UNION ALL SELECT 'zero', CASE WHEN pk % 4 = 0 THEN '1.5' ELSE '0 0' END FROM it UNION ALL SELECT 'flag', (pk % 2)::VARCHAR FROM it),
n AS (SELECT "column", v, count(*) AS n FROM c GROUP BY ALL)
SELECT "column", sum(n)::BIGINT AS rows, {r("sum(CASE WHEN trim(v) = '' THEN n ELSE 0 END) / sum(n)")} AS empty_share, {r('max(n) / sum(n)')} AS top_share,
{r("greatest(sum(CASE WHEN regexp_matches(v, '^0+$') THEN n ELSE 0 END), sum(CASE WHEN regexp_matches(v, '^1+$') THEN n ELSE 0 END), sum(CASE WHEN regexp_matches(v, '^0(\\s+0)+$') THEN n ELSE 0 END)) / sum(n)")} AS placeholder_share,
CASE "column" WHEN 'blank' THEN 'empty' WHEN 'zero' THEN 'placeholder' ELSE '' END AS problem FROM n GROUP BY "column" """)
def u08(s, d):
    pk = F.col("pk")
    df = items(s, d).select("f", F.when(pk % 50 == 0, F.lit("x")).otherwise(F.lit(" ")).alias("blank"),
                            F.when(pk % 4 == 0, F.lit("1.5")).otherwise(F.lit("0 0")).alias("zero"), (pk % 2).cast("string").alias("flag"))
    return round_all(fusion.content_quality(df, ["f", "blank", "zero", "flag"]))


QUERIES = Q
