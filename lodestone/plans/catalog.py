"""All core queries over the synthetic tables, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas, streaming
from lodestone.config import Settings
from lodestone.functions import text as T
from lodestone.operators import checks, corpus, counters, envelopes, index, models, retrieval, tables, textview
from lodestone.plans import ingest
from lodestone.plans.engine import Engine
from lodestone.sources import files
from lodestone.stage import new_folder as scratch
from lodestone.stage import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
S = T.SPACE


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _values(name: str, columns: str, rows: str) -> str:
    return f"{name}({columns}) AS (VALUES {rows})"


def _terms(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '{S}+'), lambda x: x <> ''))"


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{S}+', ' ', 'g'), ' ')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"


def _hash(c: str) -> str:
    return f"left(sha256({c}), 16)"


# --- vectors, retrieval, context -------------------------------------------------------------------------------

_KNN = "SELECT q.vec_id AS q, c.vec_id, list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)))) AS d FROM embeddings q, embeddings c WHERE {asked}"
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS rank FROM ({_KNN.format(asked="q.vec_id IN (SELECT item_id FROM benchmark)")}))"


def _knn(spark, sf_dir, asked, k=20):
    """asked: the vectors that are queries, as a condition or as rows of vec_id."""
    v = table(spark, sf_dir, "embeddings")
    chosen = v.join(asked, "vec_id", "left_semi") if isinstance(asked, DataFrame) else v.where(asked)
    return retrieval.nearest(chosen.select(F.col("vec_id").alias("q"), "embedding"), v.select("vec_id", "embedding"), k, "q", "vec_id")


@query(f"SELECT q, vec_id, round(d, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS rank FROM ({_KNN.format(asked="q.vec_id % 100 = 0")})) WHERE rank <= 20")
def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir, F.col("vec_id") % 100 == 0).select("q", "vec_id", F.round("distance", 6).alias("dist"), "rank")


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id + 1)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 6) AS norm, round(v[1] / n, 6) AS first FROM n")
def knn_normalised(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    x = table(spark, sf_dir, "embeddings").select("vec_id", T.normalized(v).alias("u"))
    return x.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, y: a + y * y), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


def _candidates(spark, sf_dir):
    """Questions are all benchmark items, whose vectors are embeddings of the same number; texts are documents."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    found = _knn(spark, sf_dir, asked.select(F.col("item_id").alias("vec_id"))).withColumnRenamed("q", "item_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    x = found.join(docs, "vec_id").join(asked, "item_id")
    child = F.col("vec_id") % 3 == 0
    return x.select(
        "item_id", "question", F.col("vec_id").alias("doc_id"), F.col("vec_id").cast("string").alias("record_id"), F.when(child, F.concat(F.lit("p"), (F.col("vec_id") % 50).cast("string"))).alias("parent_id"),
        F.when(child, "table_child").otherwise("text").alias("content_type"), F.concat(F.lit("doc "), F.col("vec_id").cast("string")).alias("title"), (F.col("vec_id") % 7 + 1).cast("int").alias("start_page"), (F.col("vec_id") % 7 + 1 + F.col("vec_id") % 2).cast("int").alias("end_page"), "text", "rank",
    )


def _reranked(spark, sf_dir):
    return retrieval.rerank(_candidates(spark, sf_dir), T.overlap("question", "text"), 8, "item_id")


_SCORED = f"""{_RANKED}, cand AS (SELECT b.item_id, b.text AS question, d.doc_id, d.text, r.rank FROM ranked r JOIN documents d ON d.doc_id = r.vec_id JOIN benchmark b ON b.item_id = r.q WHERE r.rank <= 20),
scored AS (SELECT *, len(list_intersect({_terms('question')}, {_terms('text')})) / greatest(len({_terms('question')}), 1) AS score FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC NULLS LAST, rank) AS rr FROM scored) WHERE rr <= 8)"""


@query(f"WITH {_SCORED} SELECT item_id, doc_id, round(score, 6) AS score, rr AS rank FROM best")
def lexical_rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rerank_rank").alias("rank"))


_FUNNEL = f"""{_SCORED}, keyed AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'p' || (doc_id % 50) ELSE CAST(doc_id AS VARCHAR) END AS slot FROM best),
one AS (SELECT *, row_number() OVER (PARTITION BY item_id, slot ORDER BY rr) AS n FROM keyed),
src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rr) AS source_no FROM one WHERE n = 1) WHERE source_no <= 4)"""


@query(f"WITH {_FUNNEL} SELECT item_id, source_no, doc_id, slot AS parent FROM src")
def funnel_sources(spark, sf_dir):
    x = retrieval.first_distinct(_reranked(spark, sf_dir), "item_id", retrieval.source_key(), 4)
    return x.select("item_id", "source_no", "doc_id", retrieval.source_key().alias("parent"))


@query("SELECT conv_id, turn, source_no FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS source_no FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1) WHERE source_no <= 2")
def dedup_first_n(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return retrieval.first_distinct(c, "conv_id", F.col("role"), 2, "turn").select("conv_id", "turn", "source_no")


_BUDGETS = (200, 600, 18_000)


@query(
    f"""WITH RECURSIVE {_FUNNEL}, pages AS (SELECT *, doc_id % 7 + 1 AS p0, doc_id % 7 + 1 + doc_id % 2 AS p1, doc_id % 3 = 0 AND (doc_id % 50) % 2 = 0 AS expanded FROM src),
    blocks AS (SELECT *, ' ' || CASE WHEN expanded THEN 'parent ' || slot ELSE 'doc ' || doc_id END AS title, CASE WHEN expanded THEN '3' WHEN p0 = p1 THEN CAST(p0 AS VARCHAR) ELSE p0 || ' - ' || p1 END AS pages,
      CASE WHEN expanded THEN 'Matched rows:' || chr(10) || text || chr(10) || 'Whole table:' || chr(10) ELSE '' END AS lead, CASE WHEN expanded THEN 'whole table ' || slot || ' ' || repeat('x', 300) ELSE text END AS section FROM pages),
    heads AS (SELECT *, CAST(length('[Source ' || source_no || ']' || title || ' (pages ' || pages || ')' || chr(10) || lead) AS BIGINT) AS overhead FROM blocks),
    budgets(b) AS (VALUES (200), (600), (18000)),
    fold(item_id, b, no, budget, n, chars, cut, open) AS (
      SELECT item_id, CAST(b AS BIGINT), CAST(0 AS BIGINT), CAST(b AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), true FROM (SELECT DISTINCT item_id FROM src), budgets
      UNION ALL
      SELECT f.item_id, f.b, f.no + 1, CASE WHEN ok THEN f.budget - used ELSE 0 END, CASE WHEN ok THEN f.n + 1 ELSE f.n END, CASE WHEN ok THEN f.chars + used ELSE f.chars END, CASE WHEN ok AND over THEN f.cut + 1 ELSE f.cut END, ok
      FROM (SELECT f.*, f.open AND f.budget > 0 AND h.overhead < f.budget AS ok, length(h.section) > f.budget - h.overhead AS over,
         h.overhead + CASE WHEN length(h.section) <= f.budget - h.overhead THEN length(h.section) WHEN f.budget - h.overhead <= {len(T.NOTE)} THEN f.budget - h.overhead
           ELSE length(regexp_replace(left(h.section, CAST(f.budget - h.overhead - {len(T.NOTE)} AS BIGINT)), '{S}+$', '')) + {len(T.NOTE)} END AS used
         FROM fold f JOIN heads h ON h.item_id = f.item_id AND h.source_no = f.no + 1) f)
    SELECT item_id, b AS budget, n AS n_sources, chars + 2 * greatest(n - 1, 0) AS chars, cut AS n_cut FROM (SELECT *, row_number() OVER (PARTITION BY item_id, b ORDER BY no DESC) AS last FROM fold) WHERE last = 1"""
)
def budget_prompt(spark, sf_dir):
    """The whole funnel: nearest 20, reranked 8, 4 sources, parents put in, three budgets."""
    kept = retrieval.first_distinct(_reranked(spark, sf_dir), "item_id", retrieval.source_key(), 4)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))
    pid = F.concat(F.lit("p"), F.col("id").cast("string"))
    parents = spark.range(0, 50, 2).select(pid.alias("record_id"), F.concat(F.lit("parent "), pid).alias("title"), F.array(F.lit(3)).alias("pages"), F.concat(F.lit("whole table "), pid, F.lit(" "), F.repeat(F.lit("x"), F.lit(300))).alias("text"))
    ctx = retrieval.context(kept, docs, parents)
    every = ctx.withColumn("budget", F.explode(F.array(*map(F.lit, _BUDGETS))))  # the funnel runs once
    got = retrieval.budgeted(every, ["item_id", "budget"], F.col("budget"))
    body = F.array_join(F.transform("sources", lambda s: s["text"]), "\n\n")
    return got.select("item_id", F.col("budget").cast("long").alias("budget"), F.size("sources").cast("long").alias("n_sources"), F.length(body).cast("long").alias("chars"), F.size(F.filter("sources", lambda s: s["cut"])).cast("long").alias("n_cut"))


@query(f"""WITH {_FUNNEL}, p AS (SELECT *, doc_id % 7 + 1 AS p0, doc_id % 7 + 1 + doc_id % 2 AS p1 FROM src)
    SELECT item_id, string_agg('Source ' || source_no || '|doc ' || doc_id || '|' || CASE WHEN p0 = p1 THEN 'p. ' || p0 ELSE 'pp. ' || p0 || '-' || p1 END || '|' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '|p' || (doc_id % 50) ELSE '' END, chr(10) ORDER BY source_no) AS citations FROM p GROUP BY item_id""")
def prompt_citations(spark, sf_dir):
    kept = retrieval.first_distinct(_reranked(spark, sf_dir), "item_id", retrieval.source_key(), 4)
    blocks = kept.withColumn("passage", F.col("text")).withColumn("section", F.col("text")).withColumn("expanded", F.lit(False))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    got = retrieval.prompts(retrieval.budgeted(blocks, "item_id", 10_000_000).join(asked, "item_id"))
    return got.select("item_id", F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["source_id"], c["title"], c["pages"], c["record_id"], c["parent_id"])), "\n").alias("citations"))


@query("SELECT doc_id, 'version 2 of p' || (doc_id % 50) AS section FROM documents")
def context_duplicate_parent(spark, sf_dir):
    """Each parent is there three times; the last counts, and no candidate becomes several."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("record_id"), F.concat(F.lit("p"), (F.col("doc_id") % 50).cast("string")).alias("parent_id"), F.lit("table_child").alias("content_type"), F.lit("t").alias("title"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), "text")
    pid = F.concat(F.lit("p"), (F.col("id") % 50).cast("string"))
    parents = spark.range(150).select(F.col("id").alias("ordinal"), pid.alias("record_id"), F.lit("T").alias("title"), F.array(F.lit(3)).alias("pages"), F.concat(F.lit("version "), F.expr("id div 50").cast("string"), F.lit(" of "), pid).alias("text"))
    return retrieval.context(docs, docs, parents).select("doc_id", "section")


@query("SELECT n.n_name AS child, n.n_name AS passage, coalesce(r.r_name, n.n_name) AS section, coalesce(r.r_name, n.n_name) <> n.n_name AS expanded FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON n.n_regionkey = r.r_regionkey")
def parent_expand(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kids = n.select(F.col("n_name").alias("record_id"), F.col("n_regionkey").cast("string").alias("parent_id"), F.lit("table_child").alias("content_type"), F.col("n_name").alias("title"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), F.col("n_name").alias("text"))
    whole = r.where("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("record_id"), F.col("r_name").alias("title"), F.array(F.lit(1)).alias("pages"), F.col("r_name").alias("text"))
    return retrieval.context(kids, kids.select("record_id", "title"), whole).select(F.col("record_id").alias("child"), "passage", "section", "expanded")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'stored ' || doc_id ELSE 'now ' || doc_id END AS title FROM documents")
def live_title(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    cand = d.select(name.alias("record_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("text").alias("content_type"), F.concat(F.lit("stored "), name).alias("title"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), "text", "doc_id")
    live = d.where("doc_id % 10 <> 3").select(name.alias("record_id"), F.concat(F.lit("now "), name).alias("title"))
    none = live.select("record_id", "title", F.array(F.lit(1)).alias("pages"), F.lit("").alias("text")).limit(0)
    return retrieval.context(cand, live, none).select("doc_id", "title")


# --- joins and counts --------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 7 <> 0) GROUP BY l_orderkey")
def orphan_children(spark, sf_dir):
    kids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("parent_id"), F.col("l_linenumber").cast("string").alias("record_id"), F.lit("table_child").alias("content_type"))
    up = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").cast("string").alias("record_id"))
    return corpus.orphans(kids, up).groupBy(F.col("parent_id").cast("long").alias("l_orderkey")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def accepted_semi(spark, sf_dir):
    return corpus.accepted(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


_STORED = "SELECT doc_id AS id, left(sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END), 16) AS h FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id + 1000000, 'x' FROM documents WHERE doc_id % 9 = 0"


def _sync_sides(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("record_id"), T.content_hash(text).alias("content_hash"))
    gone = d.where("doc_id % 9 = 0").select((F.col("doc_id") + 1_000_000).alias("record_id"), F.lit("x").alias("content_hash"))
    return d.select(F.col("doc_id").alias("record_id"), "text"), old.unionByName(gone)


@query(f"WITH s AS ({_STORED}) SELECT id AS doc_id FROM s WHERE id NOT IN (SELECT doc_id FROM documents)")
def removed_ids(spark, sf_dir):
    return index.changes(*_sync_sides(spark, sf_dir)).where("change = 'delete'").select(F.col("record_id").alias("doc_id"))


@query(f"WITH s AS ({_STORED}), j AS (SELECT d.doc_id, s.id, left(sha256(d.text), 16) AS now, s.h FROM documents d FULL OUTER JOIN s ON s.id = d.doc_id) SELECT count(*) FILTER (doc_id IS NOT NULL AND h IS DISTINCT FROM now) AS embedded, count(*) FILTER (doc_id IS NOT NULL AND h = now) AS unchanged, count(*) FILTER (doc_id IS NULL) AS deleted, count(doc_id) AS total FROM j")
def index_sync_report(spark, sf_dir):
    return index.sync_report(index.changes(*_sync_sides(spark, sf_dir)))


@query("SELECT doc_id, left(sha256(text), 16) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("hash"))


@query("""WITH s AS (SELECT source, count(*) FILTER (doc_id % 9 <> 0) AS v, count(*) AS c, min(doc_id) AS k FROM documents GROUP BY source)
    SELECT source, CASE WHEN k % 5 = 4 OR v = 0 THEN 'no vectors' ELSE array_to_string(list_filter([CASE WHEN v <> c THEN 'counts differ' END, CASE k % 3 WHEN 1 THEN 'no model stored' WHEN 2 THEN 'other model' END, CASE k % 4 WHEN 1 THEN 'no fingerprint stored' WHEN 2 THEN 'other fingerprint' END,
      CASE WHEN k % 2 = 1 THEN 'bad dimension' END], lambda x: x IS NOT NULL), '|') END AS problems FROM s""")
def index_problems(spark, sf_dir):
    """An index for each source of documents, with what may be wrong with it."""
    k = F.col("k")
    x = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("doc_id") % 9 != 0).alias("v"), F.count("*").alias("corpus_count"), F.min("doc_id").alias("k"))
    x = x.withColumn("vector_count", F.when(k % 5 == 4, 0).otherwise(F.col("v"))).withColumn("model", F.when(k % 3 == 1, "").when(k % 3 == 2, "o").otherwise("m")).withColumn("fingerprint", F.when(k % 4 == 2, "g").when(k % 4 != 1, "f")).withColumn("dimension", F.when(k % 2 == 0, 2).otherwise(0))
    return corpus.index_problems(x.withColumn("expected_model", F.lit("m")).withColumn("expected_fingerprint", F.lit("f"))).select("source", F.array_join("problems", "|").alias("problems"))


@query("WITH r AS (SELECT 'text' AS content_type FROM documents UNION ALL SELECT 'table_child' FROM conversations) SELECT content_type, count(*) AS n FROM r GROUP BY ROLLUP (content_type)")
def corpus_counts(spark, sf_dir):
    d, c = table(spark, sf_dir, "documents").select(F.lit("text").alias("content_type")), table(spark, sf_dir, "conversations").select(F.lit("table_child").alias("content_type"))
    return corpus.counts(d.unionByName(c))


@query("SELECT count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def duplicate_ids(spark, sf_dir):
    return corpus.duplicate_count(table(spark, sf_dir, "documents"), "text")


@query("SELECT count(DISTINCT lang) AS n_values, count(*) FILTER (lang IS NULL) AS n_null, count(DISTINCT lang) = 1 AND count(*) FILTER (lang IS NULL) = 0 AS ok FROM documents")
def single_tokenizer(spark, sf_dir):
    return corpus.single_value(table(spark, sf_dir, "documents"), "lang")


@query(f"WITH t AS (SELECT len(regexp_extract_all(text, '{S.replace('[', '[^', 1)}+')) AS n FROM documents) SELECT min(n) AS min_tokens, max(n) AS max_tokens, count(*) FILTER (n > 512) AS over_limit FROM t")
def token_stats(spark, sf_dir):
    return corpus.token_stats(table(spark, sf_dir, "documents").select(T.token_count("text").alias("token_count")), 512)


_FAULTY = f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) ELSE text END AS text, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE len(regexp_extract_all(text, '{S.replace('[', '[^', 1)}+')) END AS token_count FROM documents"


def _faulty(spark, sf_dir):
    """Documents as chunks, with faults."""
    k = F.col("doc_id")
    table_ref = F.array(F.lit("#/tables/1"), F.lit("#/texts/1"), F.lit("#/pictures/2"))
    refs = F.when(k % 19 == 0, F.array().cast("array<string>")).when(k % 23 == 0, table_ref).otherwise(F.array(F.lit("#/texts/1")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 11 == 0, " \n").otherwise(F.col("text")).alias("text"), F.when(k % 13 != 0, T.token_count("text")).alias("token_count"), F.when(k % 17 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("pages"),
        refs.alias("refs"), F.array(F.when(k % 29 == 0, " Index").otherwise("Body")).alias("headings"),
    )


_FAULTS = """SELECT 'empty_text' AS rule, count(*) FILTER (doc_id % 11 = 0) AS n FROM f UNION ALL SELECT 'over_limit', count(*) FILTER (coalesce(token_count, 513) > 512) FROM f
    UNION ALL SELECT 'no_pages', count(*) FILTER (doc_id % 17 = 0) FROM f UNION ALL SELECT 'no_refs', count(*) FILTER (doc_id % 19 = 0) FROM f UNION ALL SELECT 'table_refs', {refs} * count(*) FILTER (doc_id % 23 = 0 AND doc_id % 19 <> 0) FROM f
    UNION ALL SELECT 'navigation', count(*) FILTER (doc_id % 29 = 0) FROM f"""


@query(f"WITH f AS ({_FAULTY}) {_FAULTS.format(refs=2)}")
def qa_violations(spark, sf_dir):
    """Rows by rule; refs to tables and pictures are counted one by one."""
    return checks.violations(_faulty(spark, sf_dir), checks.text_counts(512))


@query(f"WITH f AS ({_FAULTY}), bad AS (SELECT *, doc_id % 11 = 0 OR coalesce(token_count, 513) > 512 OR doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0 OR doc_id % 29 = 0 AS bad FROM f) SELECT * FROM ({_FAULTS.format(refs=1)}) UNION ALL SELECT 'records', count(*) FILTER (NOT bad) FROM bad UNION ALL SELECT 'quarantined', count(*) FILTER (bad) FROM bad UNION ALL SELECT 'written', count(*) FILTER (NOT bad) FROM bad UNION ALL SELECT 'parted', count(*) FILTER (bad) FROM bad")
def quarantined_records(spark, sf_dir):
    """Faulty chunks are written with their checks: what the job observed, and what stands in the two folders."""
    out = scratch(spark)
    seen = checks.write_checked(_faulty(spark, sf_dir), f"{out}/good", checks.text_rules(512), "doc_id", f"{out}/bad")
    good, bad = (spark.read.schema("doc_id long, broken array<string>").json(f"{out}/{x}") for x in ("good", "bad"))
    per_rule = bad.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("found"))
    told = spark.createDataFrame(list(seen.items()), "rule string, n long").join(per_rule, "rule", "left").where("found is null or found = n").select("rule", "n")
    return told.unionByName(good.agg(F.lit("written").alias("rule"), F.count("*").alias("n"))).unionByName(bad.agg(F.lit("parted").alias("rule"), F.count("*").alias("n")))


@query("""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'bad id' ELSE 'd:text:' || lpad(CAST(doc_id AS VARCHAR), 6, '0') END AS record_id FROM documents)
    SELECT record_id || '/' || doc_id AS record_id, rule FROM (SELECT doc_id, record_id, unnest(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'schema_version' END, CASE WHEN doc_id % 7 = 0 THEN 'record_id' END, CASE WHEN doc_id % 11 = 0 THEN 'content_type' END,
      CASE WHEN doc_id % 13 = 0 THEN 'pages' END, CASE WHEN doc_id % 17 = 0 THEN 'text' END, CASE WHEN doc_id % 2 = 1 AND doc_id % 11 <> 0 AND doc_id % 3 = 0 THEN 'child_parent' END, CASE WHEN doc_id % 2 = 0 AND doc_id % 11 <> 0 AND doc_id % 19 = 0 THEN 'no_parent' END], lambda x: x IS NOT NULL)) AS rule FROM e)""")
def schema_rules(spark, sf_dir):
    k = F.col("doc_id")
    child = k % 2 == 1
    parent = F.when(child, F.when(k % 3 == 0, F.lit("")).otherwise("d:table:001")).otherwise(F.when(k % 19 == 0, "d:table:001"))
    e = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 5 == 0, "0.9").otherwise("1.0.0").alias("schema_version"), F.when(k % 7 == 0, "bad id").otherwise(F.format_string("d:text:%06d", k)).alias("record_id"), parent.alias("parent_id"), F.when(k % 11 == 0, "other").when(child, "table_child").otherwise("text").alias("content_type"),
        F.struct(F.when(k % 13 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("pages")).alias("source"), F.struct(F.when(k % 17 == 0, "").otherwise("x").alias("text")).alias("content"),
    )
    return checks.broken(e.withColumn("key", F.concat("record_id", F.lit("/"), k.cast("string"))), checks.envelope_rules(), "key").withColumnRenamed("key", "record_id")


# --- tables --------------------------------------------------------------------------------------------------------

_LINES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_PACK = f"""WITH RECURSIVE r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) AS row_no, CAST(l_quantity AS BIGINT) AS size FROM lineitem),
    g(l_orderkey, row_no, group_no, s) AS (SELECT l_orderkey, row_no, CAST(1 AS BIGINT), 5 + size FROM r WHERE row_no = 1
    UNION ALL SELECT r.l_orderkey, r.row_no, CASE WHEN g.s + r.size > 60 THEN g.group_no + 1 ELSE g.group_no END, CASE WHEN g.s + r.size > 60 THEN 5 + r.size ELSE g.s + r.size END FROM g JOIN r ON r.l_orderkey = g.l_orderkey AND r.row_no = g.row_no + 1)"""


def _packed(spark, sf_dir):
    return tables.pack(table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("long")), "l_orderkey", _LINES.split(", "), "size", 60, 5)


@query(f"{_PACK} SELECT l_orderkey, row_no, group_no FROM g")
def pack_rows(spark, sf_dir):
    return _packed(spark, sf_dir).select("l_orderkey", "row_no", "group_no")


@query("SELECT l_orderkey, l_orderkey % 10 <> 0 AS ok FROM lineitem GROUP BY l_orderkey")
def row_coverage(spark, sf_dir):
    p = _packed(spark, sf_dir).select("l_orderkey", "row_no")
    return tables.coverage(p.where("l_orderkey % 10 <> 0 or row_no > 1"), p, "l_orderkey")


@query("SELECT conv_id, count(*) = max(turn + 1) AND min(turn + 1) = 1 AND count(DISTINCT turn) = count(*) AS ok FROM conversations WHERE conv_id % 4 <> 0 OR turn <> 1 GROUP BY conv_id")
def fragment_sequence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("conv_id % 4 <> 0 or turn <> 1").withColumn("n", F.col("turn") + 1)
    return tables.consecutive(c, "conv_id", "n")


@query("""SELECT n_nationkey AS key, CASE WHEN n_nationkey % 6 = 0 THEN 'Row ' || n_nationkey || ': (empty)' WHEN n_nationkey % 5 = 0 THEN 'Row ' || n_nationkey || ':' || chr(10) || n_name || ': ' || n_regionkey ELSE 'Row ' || n_nationkey || ':' || chr(10) || 'name: ' || n_name || chr(10) || 'region: ' || n_regionkey END AS text FROM nation""")
def attribute_value_text(spark, sf_dir):
    k = F.col("n_nationkey")
    kv = (k % 5 == 0) & (k % 6 != 0)
    empty = F.array(F.lit(""), F.lit(""))
    values = F.when(k % 6 == 0, empty).when(kv, F.array(F.concat("n_name", F.lit(" ::")), F.col("n_regionkey").cast("string"))).otherwise(F.array(F.col("n_name"), F.col("n_regionkey").cast("string")))
    return table(spark, sf_dir, "nation").select(k.alias("key"), T.row_text(k, values, F.array(F.lit("name"), F.lit("region")), kv).alias("text"))


@query("SELECT n_regionkey AS region, n_regionkey % 2 = 0 AS is_kv FROM nation GROUP BY n_regionkey")
def key_value_tables(spark, sf_dir):
    second = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.col("n_nationkey").cast("string"), F.lit("x"))).otherwise(F.lit("none"))
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.array(F.col("n_name"), second)).alias("rows"))
    return g.select(F.col("n_regionkey").alias("region"), tables.is_key_value(F.col("rows"), F.lit(False), F.lit(2)).alias("is_kv"))


_CELLS = f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) - 1 AS row_no FROM lineitem)"


def _cells(spark, sf_dir):
    from pyspark.sql import Window

    x = table(spark, sf_dir, "lineitem").withColumn("row", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINES.split(", "))) - 1)
    vals = F.array(F.col("l_partkey").cast("string"), F.concat(F.lit("  "), "l_returnflag", F.lit(" \n"), "l_linestatus"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(" ")).otherwise(F.lit("odd")), F.lit("out"))
    return x.select("l_orderkey", "row", F.posexplode(vals).alias("col", "text")).withColumn("ordinal", F.col("row") * 10 + F.col("col"))


def _shape(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("num_rows")).withColumn("num_cols", F.lit(3))


@query(f"{_CELLS} SELECT l_orderkey, row_no, CAST(l_partkey AS VARCHAR) || '|' || l_returnflag || ' ' || l_linestatus || '|' || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'odd' END AS values FROM r")
def matrix_pivot(spark, sf_dir):
    return tables.matrix(_cells(spark, sf_dir), _shape(spark, sf_dir), "l_orderkey").select("l_orderkey", "row_no", F.array_join("values", "|").alias("values"))


@query(f"""{_CELLS}, h AS (SELECT l_orderkey, 0 AS col, CAST(l_partkey AS VARCHAR) AS t, row_no FROM r WHERE row_no < 2 UNION ALL SELECT l_orderkey, 1, l_returnflag || ' ' || l_linestatus, row_no FROM r WHERE row_no < 2 UNION ALL SELECT l_orderkey, 2, CASE WHEN l_linenumber % 2 = 1 THEN 'odd' END, row_no FROM r WHERE row_no < 2)
    SELECT l_orderkey, col, coalesce(string_agg(t, ' / ' ORDER BY row_no), 'Column ' || (col + 1)) AS header, count(t) = 0 AS fallback FROM h GROUP BY l_orderkey, col""")
def header_merge(spark, sf_dir):
    """The first two rows of each order's table are its headers."""
    rows = tables.matrix(_cells(spark, sf_dir), _shape(spark, sf_dir), "l_orderkey")
    return tables.headers(rows, rows.where("row_no < 2").select("l_orderkey", "row_no"), "l_orderkey")


@query("SELECT r_regionkey AS key, '| name | nation\\\\|key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey".replace("\\\\", "\\"))
def markdown_grid(spark, sf_dir):
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    rows = F.transform("rows", lambda r: F.array(r["n_name"], r["n_nationkey"].cast("string")))
    return g.select(F.col("n_regionkey").alias("key"), T.markdown(F.array(F.lit("name"), F.lit("nation|key")), rows).alias("markdown"))


@query("""WITH t AS (SELECT l_orderkey AS id, count(*) * 5 AS n, string_agg(CASE WHEN l_orderkey % 3 = 0 THEN '.....' ELSE '_' END, ' ') AS dots, 5 * count(*) FILTER (l_linenumber % 2 = 0) AS tails FROM lineitem GROUP BY l_orderkey),
    x AS (SELECT id, n, CASE WHEN id % 11 = 0 THEN 'Table of  CONTENTS' WHEN id % 5 = 0 THEN 'Figure ' || dots || repeat('.', 30) ELSE dots || repeat('_', 38) END AS text, CASE WHEN id % 4 = 0 THEN 30 ELSE 7 END AS page, tails FROM t)
    SELECT id, tails, CASE WHEN lower(text) LIKE '%contents%' AND n >= 10 THEN 'contents' WHEN page <= 20 AND n >= 20 AND len(regexp_replace(text, '[^_.]', '', 'g')) >= 40 AND tails >= 5 THEN 'navigational_list' WHEN page <= 20 AND n >= 20 AND lower(text) LIKE 'figure%' AND tails >= 5 THEN 'list_of_figures' END AS reason FROM x""")
def toc_rules(spark, sf_dir):
    """Each line stands five times in its order's grid; every other one ends in a number."""
    row = F.array(F.lit("part"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.col("l_linenumber").cast("string"))).otherwise("n/a 5"))
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.count("*") * 5).alias("n"), F.array_join(F.collect_list(F.when(F.col("l_orderkey") % 3 == 0, ".....").otherwise("_")), " ").alias("dots"), F.flatten(F.array_repeat(F.collect_list(row), 5)).alias("grid"))
    text = F.when(F.col("id") % 11 == 0, "Table of  CONTENTS").when(F.col("id") % 5 == 0, F.concat(F.lit("Figure "), "dots", F.repeat(F.lit("."), F.lit(30)))).otherwise(F.concat("dots", F.repeat(F.lit("_"), F.lit(38))))
    x = t.select("id", "n", text.alias("text"), tables.tail_rows(F.col("grid")).alias("tails"))
    return x.select("id", F.col("tails").cast("long").alias("tails"), tables.toc_reason(F.col("text"), F.col("n"), F.when(F.col("id") % 4 == 0, 30).otherwise(7), F.col("tails")).alias("reason"))


_REVIEW = "(3, 'layout', 'a note'), (5, 'duplicate', 'seen'), (40, 'layout', NULL)"
_CAPS = "(2, 'new caption'), (5, 'other')"


def _decided(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_index"), F.array("p_name").alias("caption"), F.when(F.col("p_partkey") % 5 == 0, "contents").alias("toc_reason"), F.array((F.col("p_partkey") % 9).cast("int"), F.lit(12)).alias("pages"))
    reviews = spark.sql(f"SELECT * FROM VALUES {_REVIEW} AS r(table_index, reason, note)")
    caps = spark.sql(f"SELECT table_index, array(c) AS caption FROM VALUES {_CAPS} AS c(table_index, c)")
    return tables.decide(p, reviews, caps)


_DECIDED = f"""WITH {_values('r', 'i, reason, note', _REVIEW)}, {_values('c', 'i, cap', _CAPS)}, d AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 5 = 0 OR r.reason IS NOT NULL THEN 'exclude' ELSE 'include' END AS decision,
    CASE WHEN p_partkey % 5 = 0 THEN 'contents' ELSE r.reason END AS classification, CASE WHEN p_partkey % 5 = 0 THEN 'automatic' WHEN r.reason IS NOT NULL THEN 'review' ELSE 'accepted' END AS source, coalesce(c.cap, p_name) AS caption, r.note FROM part LEFT JOIN r ON r.i = p_partkey LEFT JOIN c ON c.i = p_partkey)"""


@query(f"{_DECIDED} SELECT part, decision, classification, source, caption, note FROM d")
def decision_precedence(spark, sf_dir):
    return _decided(spark, sf_dir).select(F.col("table_index").alias("part"), "decision", "classification", F.col("review_source").alias("source"), F.array_join("caption", " ").alias("caption"), "note")


@query(f"{_DECIDED} SELECT decision, source, count(*) AS n FROM d GROUP BY ALL")
def decision_counts(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("decision", F.col("review_source").alias("source")).agg(F.count("*").alias("n"))


@query(f"{_DECIDED} SELECT '#/tables/' || part AS ref, CAST(part AS BIGINT) AS table_index, (part % 9) || ';12' AS pages, decision, classification, source AS review_source, note FROM d")
def review_csv_rows(spark, sf_dir):
    return _decided(spark, sf_dir).select(F.concat(F.lit("#/tables/"), F.col("table_index").cast("string")).alias("ref"), F.col("table_index").cast("long").alias("table_index"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ";").alias("pages"), "decision", "classification", "review_source", "note")


@query("SELECT o_orderkey AS table_index, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'inline|' || o_orderpriority ELSE o_orderpriority END AS captions FROM orders")
def caption_refs(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    ref = F.struct(F.concat(F.lit("#/texts/"), k.cast("string")).alias("ref"), F.lit(None).cast("string").alias("text"))
    inline = F.struct(F.lit(None).cast("string").alias("ref"), F.lit(" inline ").alias("text"))
    t = o.select(k.alias("table_index"), F.when(k % 3 == 0, F.array(inline, ref)).otherwise(F.array(ref)).alias("caption_refs"))
    t = t.withColumn("caption_refs", F.when(F.col("table_index") % 4 == 0, F.array().cast(t.schema["caption_refs"].dataType)).otherwise(F.col("caption_refs")))
    items = o.select(F.concat(F.lit("#/texts/"), k.cast("string")).alias("self_ref"), F.concat(F.lit(" "), "o_orderpriority").alias("text"))
    return tables.captions_of(t, items).select("table_index", F.array_join("captions", "|").alias("captions"))


# --- text view -----------------------------------------------------------------------------------------------------

_ITEMS = """SELECT doc_id, '#/texts/' || doc_id AS ref, CASE WHEN doc_id % 10 = 0 THEN 'caption' WHEN doc_id % 10 = 1 THEN 'page_footer' WHEN doc_id % 10 = 2 THEN 'section_header' ELSE 'text' END AS label, doc_id // 10 AS p0, doc_id // 10 + doc_id % 2 AS p1, doc_id % 7 = 0 AS no_page FROM documents"""


def _items(spark, sf_dir):
    k = F.col("doc_id")
    label = F.when(k % 10 == 0, "caption").when(k % 10 == 1, "page_footer").when(k % 10 == 2, "section_header").otherwise("text")
    p = F.expr("doc_id div 10").cast("int")
    pages = F.when(k % 7 == 0, F.array().cast("array<int>")).otherwise(F.array(p, (p + k % 2).cast("int")))
    text = F.when(k % 50 == 42, " INDEX\n").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("ordinal"), F.concat(F.lit("#/texts/"), k.cast("string")).alias("self_ref"), label.alias("label"), text.alias("text"), pages.alias("pages"))


@query(f"WITH i AS ({_ITEMS}) SELECT doc_id FROM i WHERE label NOT IN ('caption', 'page_footer') AND (no_page OR (p1 >= 3 AND p1 < 15)) AND doc_id % 13 <> 3")
def text_filter(spark, sf_dir):
    own = _items(spark, sf_dir)
    owners = own.where("doc_id % 13 = 3").select(F.array("self_ref").alias("captions"), F.array("self_ref").alias("footnotes"))
    return textview.keep_text(own, textview.linked_refs(owners), 3, 15).select("doc_id")


@query(f"WITH i AS ({_ITEMS}) SELECT min(p0) AS page FROM i WHERE doc_id % 50 = 42 AND NOT no_page")
def index_start(spark, sf_dir):
    return textview.index_start(_items(spark, sf_dir))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN turn // 2 WHEN turn > 0 THEN turn - 1 END AS up, turn = conv_id % 4 AND conv_id % 5 <> 0 AS root FROM conversations),
    b AS (SELECT conv_id, turn FROM t WHERE root UNION SELECT t.conv_id, t.turn FROM t JOIN b ON t.conv_id = b.conv_id AND t.up = b.turn) SELECT conv_id, turn FROM b""")
def subtree_removal(spark, sf_dir):
    """A turn hangs below an earlier one of its conversation; of most conversations one turn is taken with all below it."""
    t = F.col("turn")
    up = F.when(t % 3 == 2, F.expr("turn div 2")).when(t > 0, t - 1).cast("string")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.cast("string").alias("self_ref"), up.alias("parent_ref"))
    roots = c.where("turn = conv_id % 4 and conv_id % 5 <> 0").select("conv_id", F.col("self_ref").alias("ref"))
    return textview.subtree(c, roots, ["conv_id"]).select("conv_id", F.col("ref").cast("long").alias("turn"))


_HEADINGS = "CASE WHEN turn % 5 = 0 THEN 'Part ' || (conv_id % 3) || chr(10) WHEN turn % 5 = 2 THEN '1. Introduction' WHEN turn % 5 = 3 THEN '2.1 Detail' ELSE text END"


@query(f"""WITH h AS (SELECT conv_id, turn, CASE WHEN turn % 5 IN (0, 2, 3) AND (conv_id % 6 <> 1 OR turn > 1) THEN 'section_header' ELSE 'text' END AS label, {_strip(_HEADINGS)} AS t FROM conversations),
    f AS (SELECT *, CASE WHEN label = 'section_header' AND NOT regexp_matches(t, '^[0-9]+(\\.[0-9]+)*\\.?{S}+') THEN t END AS free FROM h),
    p AS (SELECT *, last_value(free IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS pending FROM f),
    n AS (SELECT *, CASE WHEN label = 'section_header' AND t LIKE '1. Introduction%' THEN pending END AS new FROM p)
    SELECT conv_id, turn, coalesce(last_value(new IGNORE NULLS) OVER w, first_value(free IGNORE NULLS) OVER w, '') AS chapter FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def chapter_propagation(spark, sf_dir):
    t, c = F.col("turn"), table(spark, sf_dir, "conversations")
    text = F.when(t % 5 == 0, F.concat(F.lit("Part "), (F.col("conv_id") % 3).cast("string"), F.lit("\n"))).when(t % 5 == 2, "1. Introduction").when(t % 5 == 3, "2.1 Detail").otherwise(F.col("text"))
    x = c.select("conv_id", "turn", F.when((t % 5).isin(0, 2, 3) & ((F.col("conv_id") % 6 != 1) | (t > 1)), "section_header").otherwise("text").alias("label"), text.alias("text"))
    return corpus.chapters(x, ["conv_id"], "turn").select("conv_id", "turn", "chapter")


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'c1' WHEN conv_id % 3 = 1 THEN 'c2' END AS chapter FROM conversations GROUP BY conv_id")
def chunk_chapter(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    refs = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("r0"), F.lit("r1"), F.lit("r2"))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("r2"), F.lit("r1"))).otherwise(F.array(F.lit("r0")))
    ch = spark.sql("SELECT * FROM VALUES ('r0', ' '), ('r1', ' c1'), ('r2', 'c2') AS c(self_ref, chapter)")
    x = ids.select("conv_id", refs.alias("refs"))
    return ids.join(textview.first_chapter(x, ch, "conv_id"), "conv_id", "left")


@query("SELECT row_number() OVER (ORDER BY k, a, b) AS ordinal, CASE WHEN k = 0 THEN 'd:text:' ELSE 'd:table:' END || lpad(CAST(row_number() OVER (PARTITION BY k ORDER BY a, b) AS VARCHAR), 6, '0') AS record_id FROM (SELECT 0 AS k, doc_id AS a, 0 AS b FROM documents UNION ALL SELECT 1, conv_id, turn FROM conversations)")
def ordered_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("d").alias("document_id"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"))
    c = table(spark, sf_dir, "conversations").select(F.lit("d").alias("document_id"), F.col("conv_id").alias("a"), F.col("turn").cast("long").alias("b"))
    named = corpus.with_ids(corpus.ordered_union(d, c), F.when(F.col("src_rank") == 0, "text").otherwise("table"), "a", "b", by=["document_id", "src_rank"], start=1)
    return numbered(named, ["document_id"], ["src_rank", "number"], "ordinal", 1).select("ordinal", "record_id")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Untitled section' WHEN 1 THEN 'A > B' WHEN 2 THEN 'Part > A' WHEN 3 THEN 'A' ELSE 'Table (index ' || doc_id || ')' END AS title FROM documents""")
def title_rules(spark, sf_dir):
    m = F.col("doc_id") % 5
    none = F.array().cast("array<string>")
    heads = F.when(m == 0, none).when(m == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    chapter = F.when(m == 2, " Part ").when(m == 3, "A").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(m == 4, T.table_title(none, F.col("doc_id"))).otherwise(T.text_title(heads, chapter)).alias("title"))


@query("SELECT doc_id, 1 + doc_id % 4 AS start, 1 + doc_id % 4 + doc_id % 3 AS end, list_distinct([1 + doc_id % 4, 1 + doc_id % 4 + doc_id % 3]).list_sort().list_transform(lambda x: CAST(x AS VARCHAR)).array_to_string(',') AS pages FROM documents")
def page_span(spark, sf_dir):
    a = (1 + F.col("doc_id") % 4).cast("int")
    b = (a + F.col("doc_id") % 3).cast("int")
    x = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(F.flatten(F.array(F.array(b, a), F.array(b))))).alias("pages"))
    return corpus.spans(x).select("doc_id", F.col("start_page").alias("start"), F.col("end_page").alias("end"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'p. ' || doc_id ELSE 'pp. ' || doc_id || '-' || (doc_id + 1) END AS cite_label, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || ' - ' || (doc_id + 1) END AS prompt_label FROM documents")
def page_labels(spark, sf_dir):
    a, b = F.col("doc_id"), F.col("doc_id") + F.col("doc_id") % 2
    return table(spark, sf_dir, "documents").select("doc_id", T.page_label(a, b).alias("cite_label"), T.prompt_pages(a, b).alias("prompt_label"))


@query(f"SELECT doc_id AS id, {_collapse('s')} AS text, left({_collapse('s')}, 160) AS preview, {_strip('s')} AS stripped FROM (SELECT doc_id, chr(160) || chr(12288) || ' ' || replace(text, ' ', CASE WHEN doc_id % 2 = 0 THEN chr(10) || ' ' ELSE chr(8195) END) || chr(31) AS s FROM documents)")
def whitespace_norm(spark, sf_dir):
    gap = F.when(F.col("doc_id") % 2 == 0, "\n ").otherwise(" ")
    x = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" 　 "), F.replace("text", F.lit(" "), gap), F.lit("\x1f")).alias("s"))
    return x.select(F.col("doc_id").alias("id"), T.collapse("s").alias("text"), T.preview("s").alias("preview"), T.strip("s").alias("stripped"))


@query("SELECT page_id AS id, trim(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '-') AS slug FROM pages UNION ALL SELECT doc_id + 1000000, trim(regexp_replace(lower('--' || source || ' ' || lang || '!'), '[^a-z0-9._-]+', '-', 'g'), '-') FROM documents")
def slug_id(spark, sf_dir):
    a = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.slug("url").alias("slug"))
    return a.unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000).alias("id"), T.slug(F.concat(F.lit("--"), "source", F.lit(" "), "lang", F.lit("!"))).alias("slug")))


_LANGS = "(-1, '資料治理是什麼', 'auto'), (-2, 'ひらがな', 'auto'), (-3, 'what is DMBOK', 'auto'), (-4, 'explain 數據 lineage', 'auto'), (-5, '한국어', 'auto'), (-6, '資料', 'en'), (-7, 'plain', 'zh-hant'), (-8, 'plain', 'fr')"


@query(f"WITH {_values('v', 'id, q, s', _LANGS)}, a AS (SELECT * FROM v UNION ALL SELECT doc_id, text, 'auto' FROM documents) SELECT id, CASE WHEN s IN ('en', 'zh-hant') THEN s WHEN regexp_matches(q, '{T.CJK}') THEN 'zh-hant' ELSE 'en' END AS lang FROM a")
def detect_language(spark, sf_dir):
    v = spark.sql(f"SELECT CAST(id AS BIGINT) AS id, q, s FROM VALUES {_LANGS} AS v(id, q, s)")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("q"), F.lit("auto").alias("s"))
    return v.unionByName(d).select("id", T.language("q", F.col("s")).alias("lang"))


_N = len(T.NOTE)


@query(f"SELECT doc_id, b AS budget, CASE WHEN length(text) <= b THEN length(text) WHEN b <= {_N} THEN b ELSE length(regexp_replace(left(text, CAST(b - {_N} AS BIGINT)), '{S}+$', '')) + {_N} END AS n, length(text) > b AS truncated FROM documents, (VALUES (10), (60), (600)) AS x(b)")
def truncate_fit(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(F.lit(10), F.lit(60), F.lit(600))).alias("budget"))
    x = x.withColumn("f", T.fit("text", "budget"))
    return x.select("doc_id", "budget", F.length("f.text").cast("long").alias("n"), F.col("f.cut").alias("truncated"))


@query("SELECT doc_id, CAST(length(text) AS FLOAT) AS v0, CAST(1 AS FLOAT) AS v1 FROM documents")
def embed_length(spark, sf_dir):
    e = models.length_embedder()
    x = table(spark, sf_dir, "documents").select("doc_id", e.documents(F.col("text")).alias("v"))
    return x.select("doc_id", F.get("v", F.lit(0)).alias("v0"), F.get("v", F.lit(1)).alias("v1"))


@query("SELECT lang, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1")
def last_row_wins(spark, sf_dir):
    return corpus.last_of(table(spark, sf_dir, "documents").select("lang", "doc_id", "source"), "lang", "doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_strip('CASE WHEN doc_id % 9 = 0 THEN chr(160) || chr(10) ELSE text END')} <> ''")
def blank_questions(spark, sf_dir):
    q = F.when(F.col("doc_id") % 9 == 0, " \n").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where(T.strip(q) != "").select("doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS record_id, left(sha256(text), 16) AS content_hash, '' AS parent_id, '1,2' AS pages, 1 AS start_page, 2 AS end_page FROM documents")
def flat_metadata(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "text", F.lit(None).cast("string").alias("parent_id"), F.lit("text").alias("content_type"), F.lit("d").alias("document_id"), F.lit("t").alias("title"), F.array(F.lit(1), F.lit(2)).alias("pages"), F.lit(0).alias("token_count"))
    return corpus.flat_metadata(r).select("record_id", "content_hash", "parent_id", "pages", "start_page", "end_page")


@query("SELECT count(*) FILTER (doc_id % 3 <> 0) AS text, count(*) FILTER (doc_id % 3 = 0) AS table_child, count(*) AS total FROM documents")
def type_counts(spark, sf_dir):
    return corpus.type_counts(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "table_child").otherwise("text").alias("content_type")))


@query(f"WITH i AS ({_ITEMS}) SELECT 'label' AS rule, count(*) FILTER (label IN ('caption', 'page_footer')) AS n FROM i UNION ALL SELECT 'dangling', count(*) FILTER (doc_id % 21 = 0) FROM i UNION ALL SELECT 'before', count(*) FILTER (NOT no_page AND p0 < 3) FROM i UNION ALL SELECT 'after', count(*) FILTER (NOT no_page AND p1 >= 15) FROM i")
def view_checks(spark, sf_dir):
    x = _items(spark, sf_dir).withColumn("parent_ref", F.when(F.col("doc_id") % 21 == 0, "#/tables/4").otherwise("#/body"))
    return checks.violations(x, checks.view_rules(3, 15))


@query("SELECT conv_id, 'Table: turns' || chr(10) || chr(10) || string_agg('Row ' || turn || ':' || chr(10) || 'role: ' || role, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def embedding_texts(spark, sf_dir):
    row = T.row_text(F.col("turn"), F.array("role"), F.array(F.lit("role")), F.lit(False))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("t")))).alias("rows"))
    return g.select("conv_id", T.embedding_text(F.array(F.lit("turns")), F.array(F.lit("role")), F.transform("rows", lambda r: r["t"])).alias("text"))


# --- rows only: what SQL can't say ---------------------------------------------------------------------------------


@query("SELECT doc_id, text, CAST(NULL AS VARCHAR) AS parent_id FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Written as JSON lines and read again: nulls and non-ASCII text stay."""
    path = scratch(spark)
    files.write_lines(table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("parent_id")), path)
    return files.read_lines(spark, path, "doc_id long, text string, parent_id string")


@query("""WITH x AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 10 = 9) AS gone, count(*) FILTER (doc_id % 10 <> 9 AND doc_id % 7 = 0) AS changed FROM documents)
SELECT n AS embedded, 0 AS unchanged, 0 AS deleted, n AS total, 'length-2d' AS model, 2 AS dimension, false AS rebuilt, 1 AS run FROM x UNION ALL SELECT changed, n - gone - changed, gone, n - gone, 'length-2d', 2, false, 2 FROM x""")
def index_build(spark, sf_dir):
    """Builds an index, changes records, syncs again; gives both reports."""
    store = index.VectorIndex(spark, scratch(spark))
    e = models.length_embedder()
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("text").alias("content_type"), F.col("source").alias("title"), F.array(F.lit(1)).alias("pages"), "text")
    one = store.sync(r, e)
    two = store.sync(r.where("record_id % 10 <> 9").withColumn("text", F.when(F.expr("record_id % 7 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))), e)
    return one.withColumn("run", F.lit(1)).unionByName(two.withColumn("run", F.lit(2)))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{S.replace('[', '[^', 1)}+{S}*') AS w FROM documents), f AS (SELECT doc_id, w, unnest(range((len(w) + 121) // 122)) AS k FROM w)
    SELECT doc_id, 1 AS row_no, k + 1 AS fragment_no, (len(w) + 121) // 122 AS n_fragments, regexp_replace(array_to_string(list_slice(w, k * 122 + 1, k * 122 + 122), ''), '{S}+$', '') AS text FROM f""")
def oversize_rows(spark, sf_dir):
    """Texts as rows too large for a chunk of 128 words, 6 of them the label: fragments of 122."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("row_no"), "text", F.lit("Columns: text\n\nRow 1 fragment 999/999: ").alias("prefix"))
    return tables.fragments(x, "doc_id", 128)


_TURNS = f"len(regexp_extract_all(text, '{S.replace('[', '[^', 1)}+'))"


def _chunk_sql(room: int) -> str:
    """g(conv_id, number, role, text, n, refs, pages): turns under their role, packed to so many words; longer ones are cut first."""
    other = S.replace("[", "[^", 1)
    return f"""t AS (SELECT conv_id, turn, role, regexp_replace(text, '^{S}+|{S}+$', '', 'g') AS text, {_TURNS} AS n FROM conversations),
    parts AS (SELECT conv_id, turn, role, 0 AS part, text AS p, n FROM t WHERE n BETWEEN 1 AND {room} UNION ALL
      SELECT conv_id, turn, role, part, regexp_replace(array_to_string(list_slice(w, part * {room} + 1, part * {room} + {room}), ''), '{S}+$', ''), least({room}, n - part * {room}) FROM (SELECT *, regexp_extract_all(text, '{other}+{S}*') AS w, unnest(range((n + {room - 1}) // {room})) AS part FROM t WHERE n > {room})),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS r FROM parts),
    f(conv_id, r, number, role, s) AS (SELECT conv_id, r, CAST(1 AS BIGINT), role, n FROM r WHERE r = 1 UNION ALL
      SELECT r.conv_id, r.r, CASE WHEN r.role = f.role AND f.s + r.n <= {room} THEN f.number ELSE f.number + 1 END, r.role, CASE WHEN r.role = f.role AND f.s + r.n <= {room} THEN f.s + r.n ELSE r.n END FROM f JOIN r ON r.conv_id = f.conv_id AND r.r = f.r + 1),
    g AS (SELECT conv_id, number, f.role, string_agg(p, chr(10) ORDER BY r) AS text, CAST(sum(n) AS BIGINT) AS n, list(DISTINCT turn ORDER BY turn) AS turns FROM f JOIN r USING (conv_id, r) GROUP BY conv_id, number, f.role)"""


@query(f"WITH RECURSIVE {_chunk_sql(119)} SELECT conv_id, number, role AS headings, text, n + 1 AS token_count, array_to_string(list_transform(turns, lambda x: '#/texts/' || x), ',') AS refs, array_to_string(list_transform(turns, lambda x: CAST(x + 1 AS VARCHAR)), ',') AS pages FROM g")
def text_chunks(spark, sf_dir):
    """Turns of a conversation as the items of a document, under the heading of their role, which counts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.array("role").alias("headings"), F.concat(F.lit("#/texts/"), F.col("turn").cast("string")).alias("self_ref"), F.array((F.col("turn") + 1).cast("int")).alias("pages"), "text")
    x = textview.chunk(c, "conv_id", 120)
    return x.select("conv_id", F.col("number").cast("long").alias("number"), F.array_join("headings", "|").alias("headings"), "text", F.col("token_count").cast("long").alias("token_count"), F.array_join("refs", ",").alias("refs"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query(
    f"""WITH {_FUNNEL}, h AS (SELECT item_id, text, 4000 - length('[Source 1] doc ' || doc_id || ' (pages ' || (doc_id % 7 + 1) || CASE WHEN doc_id % 2 = 1 THEN ' - ' || (doc_id % 7 + 2) ELSE '' END || ')' || chr(10)) AS room FROM src WHERE source_no = 1),
    t AS (SELECT item_id, CASE WHEN length(text) <= room THEN text ELSE regexp_replace(left(text, CAST(room - {_N} AS BIGINT)), '{S}+$', '') END AS t FROM h)
    SELECT item_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^{S}+|{S}+$', '', 'g')), lambda x: x <> '')[1] || ' [Source 1]' AS answer, 'extractive' AS model FROM t"""
)
def generated_answers(spark, sf_dir):
    kept = retrieval.first_distinct(_reranked(spark, sf_dir), "item_id", retrieval.source_key(), 4)
    blocks = kept.withColumn("passage", F.col("text")).withColumn("section", F.col("text")).withColumn("expanded", F.lit(False))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    got = retrieval.prompts(retrieval.budgeted(blocks, "item_id", 4000).join(asked, "item_id")).select("item_id", "prompt")
    return models.generate(got, models.extractive_model()).select("item_id", "answer", "model")


@query("SELECT sha256('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' || chr(10)) AS sha256, length(r_name) + 30 AS length FROM region")
def file_digests(spark, sf_dir):
    """A file of one JSON line for each region: what each holds, byte by byte."""
    path = scratch(spark)
    table(spark, sf_dir, "region").repartitionById(64, F.col("r_regionkey").cast("int")).write.json(path)
    found = files.read_binary(spark, path).where("path like '%part-%'")
    return files.digest(found).join(found.select("path", "length"), "path").where("length > 0").select("sha256", "length")


# --- ingestion: stored records, checks, files ------------------------------------------------------------------------

_WORDS = f"len(regexp_extract_all(text, '{S.replace('[', '[^', 1)}+'))"


def _chunks(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        T.slug("source").alias("document_id"), F.lit("a.pdf").alias("source_filename"), k.alias("number"), F.array(F.lit(" A "), F.lit(" "), "lang").alias("headings"), F.array().cast("array<string>").alias("captions"), F.when(k % 2 == 0, "Part").alias("chapter"),
        F.transform(F.array(k + 1, k, k + 1), lambda x: F.concat(F.lit("#/texts/"), x.cast("string"))).alias("refs"), F.array((k % 9 + 2).cast("int"), (k % 9 + 1).cast("int"), (k % 9 + 2).cast("int")).alias("pages"), "text", T.token_count("text").alias("token_count"),
    )


@query(f"""SELECT '1.0.0' AS schema_version, trim(regexp_replace(lower(source), '[^a-z0-9._-]+', '-', 'g'), '-') || ':text:' || format('{{:06d}}', doc_id) AS record_id, CAST(NULL AS VARCHAR) AS parent_id, 'text' AS content_type,
    (doc_id % 9 + 1) || ',' || (doc_id % 9 + 2) AS pages, '#/texts/' || (doc_id + 1) || ',#/texts/' || doc_id AS refs, 'A|' || lang AS headings, CASE WHEN doc_id % 2 = 0 THEN 'Part' END AS chapter, {_WORDS} AS token_count, 480 AS target, 512 AS most, text FROM documents""")
def envelope_text(spark, sf_dir):
    r = envelopes.texts(_chunks(spark, sf_dir), "words", 480, 512)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return r.select("schema_version", "record_id", "parent_id", "content_type", joined("source.pages").alias("pages"), joined("source.locators.refs").alias("refs"), F.array_join("metadata.headings", "|").alias("headings"), "metadata.chapter", "metadata.token_count", F.col("metadata.chunk_target_tokens").alias("target"), F.col("metadata.chunk_max_tokens").alias("most"), F.col("content.text").alias("text"))


@query("""SELECT 'd:table:' || format('{:03d}', l_orderkey) || ':child:000' AS record_id, 'd:table:' || format('{:03d}', l_orderkey) || ':parent:000' AS parent_id,
    string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS rows, count(*) AS n_rows, l_orderkey % 5 = 0 AS row_fragmented, CASE WHEN l_orderkey % 2 = 0 THEN 'key_value_v1' ELSE 'attribute_value_v1' END AS form FROM lineitem GROUP BY l_orderkey""")
def envelope_child(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("row_index"), F.array("l_returnflag").alias("values")))).alias("rows"))
    none = F.lit(None).cast("array<struct<l:double>>")
    parts = rows.select(F.lit("d").alias("document_id"), F.lit("a.pdf").alias("source_filename"), k.alias("table_index"), F.lit(0).alias("number"), F.lit("#/tables/0").alias("ref"), F.array(F.lit(1)).alias("pages"), none.alias("boxes"), F.array(F.lit("c")).alias("captions"), F.array(F.lit("flag")).alias("header"), F.array(F.lit(0)).alias("header_rows"), F.lit(False).alias("synthetic"), (k % 2 == 0).alias("key_value"), "rows", F.lit("t").alias("text"), F.lit("m").alias("markdown"), F.lit(1).alias("token_count"), F.when(k % 5 == 0, F.struct(F.lit(1).alias("fragment"))).alias("fragment"))
    r = envelopes.table_children(parts, "words", 480, 512)
    return r.select("record_id", "parent_id", F.array_join(F.transform("source.locators.row_indices", lambda x: x.cast("string")), ",").alias("rows"), F.size("content.structured.rows").cast("long").alias("n_rows"), "metadata.row_fragmented", F.col("metadata.embedding_serialization").alias("form"))


def _region_tables(spark, sf_dir):
    """A table for each region: its nations, with a header row."""
    n = table(spark, sf_dir, "nation").withColumn("name", F.concat(F.lit("  "), "n_name", F.lit("\n")))
    cell = lambda text, col, head: F.struct(text.alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(0).alias("start_row_offset_idx"), F.lit(1).alias("end_row_offset_idx"), F.lit(col).alias("start_col_offset_idx"), F.lit(col + 1).alias("end_col_offset_idx"), F.lit(head).alias("column_header"), F.lit(False).alias("row_header"), F.lit(False).alias("row_section"), F.lit(None).cast("struct<l:double,t:double,r:double,b:double,coord_origin:string>").alias("bbox"))
    per = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "name"))).alias("x"))
    k = F.col("n_regionkey")
    grid = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("x", lambda r: F.array(r["n_nationkey"].cast("string"), T.collapse(r["name"]))))
    return per.select(F.lit("doc").alias("document_id"), F.lit("a.pdf").alias("source_filename"), k.alias("table_index"), F.lit("#/tables/0").alias("ref"), F.array(k + 1).alias("pages"), F.lit(None).cast("array<struct<l:double>>").alias("boxes"), F.array(F.lit("Nations")).alias("captions"), (F.size("x") + 1).alias("num_rows"), F.lit(2).alias("num_cols"), F.lit("rot_0").alias("orientation"), F.transform("x", lambda r: cell(r["name"], 1, False)).alias("cells"), grid.alias("grid"), F.when(k == 3, "exclude").otherwise("include").alias("decision"), F.lit("accepted").alias("review_source"))


@query("""SELECT 'doc:table:00' || n_regionkey || ':parent:000' AS record_id, 'table_parent' AS content_type, 'key' || chr(9) || 'name' || chr(10) || string_agg(n_nationkey || chr(9) || n_name, chr(10) ORDER BY n_nationkey) AS text,
    '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown, 'Nations' AS caption, count(*) + 1 AS num_rows, 'accepted' AS review_status FROM nation WHERE n_regionkey <> 3 GROUP BY n_regionkey""")
def canonical_parent(spark, sf_dir):
    r = envelopes.table_parents(_region_tables(spark, sf_dir))
    return r.select("record_id", "content_type", "content.text", "content.markdown", F.array_join("metadata.caption", " ").alias("caption"), F.col("metadata.num_rows").cast("long").alias("num_rows"), "metadata.review_status")


@query("SELECT n_regionkey AS table_index, n_name AS text, 1 AS col, true AS no_box FROM nation WHERE n_regionkey <> 3")
def structured_cells(spark, sf_dir):
    r = envelopes.table_parents(_region_tables(spark, sf_dir)).select(F.col("metadata.table_index").alias("table_index"), F.explode("content.structured.cells").alias("c"))
    return r.select("table_index", "c.text", F.col("c.start_col_offset_idx").alias("col"), F.col("c.bbox").isNull().alias("no_box"))


@query("""WITH r AS (SELECT doc_id, doc_id % 3 = 0 AS child, doc_id % 40 = 7 AS again FROM documents)
SELECT count(*) + count(*) FILTER (again) AS records, count(*) FILTER (NOT child) + count(*) FILTER (again AND NOT child) AS text_records, count(*) FILTER (child) + count(*) FILTER (again AND child) AS table_child_records, count(*) FILTER (again) AS duplicate_ids, CAST(0 AS BIGINT) AS content_type,
  count(*) FILTER (doc_id % 11 = 0) + count(*) FILTER (again AND doc_id % 11 = 0) AS empty_text, count(*) FILTER (doc_id % 13 = 0) + count(*) FILTER (again AND doc_id % 13 = 0) AS over_limit, CAST(2 AS BIGINT) AS tokenizers, CAST(1 AS BIGINT) AS documents,
  count(*) FILTER (child AND doc_id % 50 % 7 = 0) + count(*) FILTER (again AND child AND doc_id % 50 % 7 = 0) AS invalid_parent_links FROM r""")
def combined_validation(spark, sf_dir):
    """Records with injected faults: repeated ids, empty texts, missing counts, two tokenizers, missing parents."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    d = d.unionByName(d.where(k % 40 == 7))
    child, pid = k % 3 == 0, lambda c: F.concat(F.lit("d:table:"), F.lpad(c.cast("string"), 3, "0"), F.lit(":parent:000"))
    records = d.select(
        F.lit("1.0.0").alias("schema_version"), F.concat(F.lit("d:text:"), F.lpad(k.cast("string"), 6, "0")).alias("record_id"), F.when(child, pid(k % 50)).alias("parent_id"), F.when(child, "table_child").otherwise("text").alias("content_type"), F.struct(F.lit("d").alias("document_id"), F.array(F.lit(1)).alias("pages")).alias("source"),
        F.struct(F.when(k % 11 == 0, " ").otherwise("x").alias("text")).alias("content"), F.struct(F.when(k % 13 != 0, F.lit(5)).alias("token_count"), F.when(k == 0, "other").otherwise("words").alias("tokenizer_name")).alias("metadata"),
    )
    parents = spark.range(50).where("id % 7 <> 0").select(pid(F.col("id")).alias("record_id"))
    return checks.combined_figures(records, parents, 512).drop("no_tokenizer", "no_document", "schema_errors")


@query("SELECT l_orderkey, row_no, row_no AS v FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS row_no FROM lineitem) WHERE row_no > 1 + l_orderkey % 2")
def data_rows(spark, sf_dir):
    """Header rows aren't packed: the first of a table, and the second of every other one."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count().select("l_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("row_no"))
    heads = x.where(F.col("row_no") <= 1 + F.col("l_orderkey") % 2)
    return tables.data_rows(x, heads, "l_orderkey").withColumn("v", F.col("row_no"))


@query("SELECT doc_id, n_chars, lang FROM documents WHERE doc_id % 3 <> 0")
def index_deltas(spark, sf_dir):
    """An index by upserts and deletions: of one id the last part counts."""
    store = index.VectorIndex(spark, scratch(spark))
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("text").alias("content_type"), F.lit("old").alias("title"), F.lit(0).alias("start_page"), F.lit(0).alias("end_page"), "text", F.lit("h").alias("content_hash"), F.array(F.lit(0.0).cast("float")).alias("embedding"), "lang", F.col("n_chars").cast("int").alias("n"))
    store.put(r, {"embedding_model": "m", "embedding_dimension": 1, "embedding_fingerprint": "f"})
    store.upsert(r.withColumn("title", F.col("lang")).withColumn("start_page", F.col("n")))
    store.delete(r.where("record_id % 3 = 0"))
    return store.rows().select(F.col("record_id").cast("long").alias("doc_id"), F.col("start_page").cast("long").alias("n_chars"), F.col("title").alias("lang"))


@query("SELECT CASE WHEN item_id % 2 = 0 THEN 'book' END AS document_id, item_id AS table_index, text AS caption FROM benchmark")
def caption_overrides(spark, sf_dir):
    """Overrides written as JSON objects, 16 files of them, and read again; a missing file has none."""
    path = scratch(spark)
    k = F.col("item_id").cast("string")
    b = table(spark, sf_dir, "benchmark").select(F.pmod(F.xxhash64("item_id"), F.lit(16)).alias("file"), F.struct(F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("book:"), k)).otherwise(k), F.array("text")).alias("pair"))
    b.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list("pair"))).alias("value")).write.partitionBy("file").text(path)
    got = files.read_overrides(spark, path).unionByName(files.read_overrides(spark, f"{path}/none"))
    return got.select("document_id", F.col("table_index").cast("long").alias("table_index"), F.get("caption", F.lit(0)).alias("caption"))


@query("SELECT label, count(*) AS before, count(*) FILTER (NOT label IN ('caption', 'page_footer') AND (no_page OR (p1 >= 3 AND p1 < 15))) AS after FROM (" + _ITEMS + ") GROUP BY label")
def view_counts(spark, sf_dir):
    """Items by label before and after the text view's filter."""
    own = _items(spark, sf_dir)
    kept = textview.keep_text(own, own.limit(0).select(F.col("self_ref").alias("ref")), 3, 15)
    both = own.select("label", F.lit(0).alias("kept")).unionByName(kept.select("label", F.lit(1).alias("kept")))
    return both.groupBy("label").agg(F.count_if(F.col("kept") == 0).alias("before"), F.count_if(F.col("kept") == 1).alias("after"))


@query("SELECT doc_id, array_to_string(list_transform(CASE WHEN doc_id % 3 = doc_id % 2 THEN [doc_id % 3] ELSE [doc_id % 3, doc_id % 2] END, lambda x: '#/texts/' || x), ',') AS refs FROM documents")
def chunk_refs(spark, sf_dir):
    """Refs of a chunk's record, each once, in the order of their first place."""
    k = F.col("doc_id")
    own = _chunks(spark, sf_dir).drop("doc_id").withColumnRenamed("number", "doc_id").withColumn("number", k).withColumn("refs", F.transform(F.array(k % 3, k % 2, k % 3), lambda x: F.concat(F.lit("#/texts/"), x.cast("string"))))
    r = envelopes.texts(own, "words", 480, 512)
    return r.select(F.regexp_extract("record_id", "([0-9]+)$", 1).cast("long").alias("doc_id"), F.array_join("source.locators.refs", ",").alias("refs"))


# --- ingestion of several documents ----------------------------------------------------------------------------------


def _none(field: str):
    """A field of a parsed document that it doesn't have."""
    return F.from_json(F.lit("{}"), schemas.DOCUMENT)[field].alias(field)


def _conversations_as_documents(spark, sf_dir):
    """A document for each conversation: its turns are items whose refs begin anew in each; every other one has a picture."""
    t, c = F.col("turn"), F.col("conv_id")
    ref = lambda x: F.concat(F.lit("#/texts/"), x.cast("string"))
    parent = F.when(t % 7 == 5, F.lit("#/pictures/0")).when(t % 7 == 6, ref(t - 1)).otherwise("#/body")
    index = (t % 5 == 2) & (c % 4 == 0)
    item = F.struct(ref(t).alias("self_ref"), F.when(t % 5 == 4, "page_footer").when(index, "section_header").otherwise("text").alias("label"), F.when(index, " Index").otherwise(F.col("text")).alias("text"), F.array("role").alias("headings"), F.struct(parent.alias("ref")).alias("parent"), F.array(F.struct((t + 1).cast("int").alias("page_no"))).alias("prov"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda x: x["item"])
    x = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(texts.alias("texts"))
    caption = F.when(c % 3 == 0, F.array(F.struct(F.lit("#/texts/1").alias("ref"), F.lit(None).cast("string").alias("text"))))
    picture = F.struct(F.lit("#/pictures/0").alias("self_ref"), caption.alias("captions"), F.lit(None).cast("array<struct<ref:string,text:string>>").alias("footnotes"))
    return x.select(F.concat(F.lit("conv-"), c.cast("string")).alias("document_id"), F.lit("c.pdf").alias("source_filename"), "texts", _none("tables"), F.when(c % 2 == 0, F.array(picture)).alias("pictures"))


@query("""WITH i AS (SELECT conv_id, turn, min(turn + 1) FILTER (turn % 5 = 2 AND conv_id % 4 = 0) OVER (PARTITION BY conv_id) AS page FROM conversations)
    SELECT 'conv-' || conv_id AS document_id, '#/texts/' || turn AS ref FROM i WHERE turn % 5 <> 4 AND turn >= 1 AND (page IS NULL OR turn + 1 < page) AND NOT (conv_id % 2 = 0 AND (turn % 7 IN (5, 6) OR conv_id % 3 = 0 AND turn = 1))""")
def document_views(spark, sf_dir):
    """The text view of many documents at once: each has its own index page, captions and subtrees."""
    kept, _ = ingest.view(_conversations_as_documents(spark, sf_dir), 2)
    return kept.select("document_id", F.col("self_ref").alias("ref"))


@query(f"WITH RECURSIVE {_chunk_sql(59)} SELECT 'conv-' || conv_id || ':text:' || format('{{:06d}}', number) AS record_id, role || chr(10) || text AS text, n + 1 AS token_count, array_to_string(list_transform(turns, lambda x: '#/texts/' || x), ',') AS refs, array_to_string(list_transform(turns, lambda x: CAST(x + 1 AS VARCHAR)), ',') AS pages FROM g")
def document_texts(spark, sf_dir):
    """Text records of many documents, written with their checks and read again: no chunk is over its limit with its headings."""
    c = table(spark, sf_dir, "conversations")
    own = c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("document_id"), F.lit("c.pdf").alias("source_filename"), F.col("turn").cast("long").alias("ordinal"), F.concat(F.lit("#/texts/"), F.col("turn").cast("string")).alias("self_ref"), F.lit("text").alias("label"), "text", F.array("role").alias("headings"), F.array((F.col("turn") + 1).cast("int")).alias("pages"))
    path = scratch(spark)
    ingest.write_texts(ingest.text_records(own, 60, 60), path, 60)
    r = files.read_lines(spark, path, schemas.ENVELOPE)
    return r.select("record_id", "content.text", F.col("metadata.token_count").cast("long").alias("token_count"), F.array_join("source.locators.refs", ",").alias("refs"), F.array_join(F.transform("source.pages", lambda p: p.cast("string")), ",").alias("pages"))


_NATIONS = f"""r AS (SELECT n_regionkey AS k, r_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, n_nationkey, n_name, 5 + len(regexp_extract_all(n_name, '{S.replace('[', '[^', 1)}+')) AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 3),
    g(k, i, g, s) AS (SELECT k, i, CAST(0 AS BIGINT), n FROM r WHERE i = 1 UNION ALL SELECT r.k, r.i, CASE WHEN g.s + r.n > 13 THEN g.g + 1 ELSE g.g END, CASE WHEN g.s + r.n > 13 THEN r.n ELSE g.s + r.n END FROM g JOIN r ON r.k = g.k AND r.i = g.i + 1)"""


@query(f"""WITH RECURSIVE {_NATIONS} SELECT 'region-' || k || ':table:000:child:' || format('{{:03d}}', g) AS record_id, 'region-' || k || ':table:000:parent:000' AS parent_id,
    'Table: Nations of ' || any_value(r_name) || chr(10) || chr(10) || string_agg('Row ' || i || ':' || chr(10) || 'key: ' || n_nationkey || chr(10) || 'name: ' || n_name, chr(10) || chr(10) ORDER BY i) AS text, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS rows FROM g JOIN r USING (k, i) GROUP BY k, g""")
def document_tables(spark, sf_dir):
    """A document for each region, each with one table and one caption, of the same refs and numbers; one is left out by a review of its own."""
    k = F.col("r_regionkey")
    cell = lambda text, row, col: F.struct(text.alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), row.cast("int").alias("start_row_offset_idx"), (row + 1).cast("int").alias("end_row_offset_idx"), F.lit(col).alias("start_col_offset_idx"), F.lit(col + 1).alias("end_col_offset_idx"), (row == 0).alias("column_header"), F.lit(False).alias("row_header"), F.lit(False).alias("row_section"), F.lit(None).cast("struct<l:double,t:double,r:double,b:double,coord_origin:string>").alias("bbox"))
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    rows = F.concat(F.array(F.struct(F.lit("key").alias("a"), F.lit("name").alias("b"))), F.transform("x", lambda r: F.struct(r["n_nationkey"].cast("string").alias("a"), r["n_name"].alias("b"))))
    cells = F.flatten(F.transform(rows, lambda r, i: F.array(cell(r["a"], i, 0), cell(r["b"], i, 1))))
    data = F.struct((F.size("x") + 1).alias("num_rows"), F.lit(2).alias("num_cols"), F.lit("rot_0").alias("orientation"), F.transform(rows, lambda r: F.array(F.struct(r["a"].alias("text")), F.struct(r["b"].alias("text")))).alias("grid"), cells.alias("table_cells"))
    refs = F.array(F.struct(F.lit("#/texts/0").alias("ref"), F.lit(None).cast("string").alias("text")))
    prov = F.array(F.struct(F.lit(30).alias("page_no"), F.lit(None).cast("struct<l:double,t:double,r:double,b:double,coord_origin:string>").alias("bbox")))
    caption = F.struct(F.lit("#/texts/0").alias("self_ref"), F.lit("caption").alias("label"), F.concat(F.lit("Nations of "), "r_name").alias("text"), F.array().cast("array<string>").alias("headings"), F.struct(F.lit("#/body").alias("ref")).alias("parent"), F.array(F.struct(F.lit(30).alias("page_no"))).alias("prov"))
    own = F.struct(F.lit("#/tables/0").alias("self_ref"), refs.alias("captions"), F.lit(None).cast("array<struct<ref:string,text:string>>").alias("footnotes"), prov.alias("prov"), data.alias("data"))
    docs = n.join(table(spark, sf_dir, "region"), "r_regionkey").select(F.concat(F.lit("region-"), k.cast("string")).alias("document_id"), F.lit("r.pdf").alias("source_filename"), F.array(caption).alias("texts"), F.array(own).alias("tables"), _none("pictures"))
    reviews = docs.where("document_id = 'region-3'").select("document_id", F.lit(0).alias("table_index"), F.lit("layout").alias("reason"), F.lit("a note").alias("note"))
    decided = ingest.inventory(docs, reviews, docs.limit(0).select("document_id", F.lit(0).alias("table_index"), F.array("document_id").alias("caption")))
    path = scratch(spark)
    ingest.write_children(ingest.table_records(decided, 13, 40), decided, path, 40)
    r = spark.read.schema(schemas.ENVELOPE.replace("content struct<text:string,markdown:string>", "content struct<text:string,structured:struct<row_indices:array<int>>>")).json(path)
    return r.select("record_id", "parent_id", "content.text", F.array_join(F.transform("content.structured.row_indices", lambda x: x.cast("string")), ",").alias("rows"))


@query()
def subword_packs(spark, sf_dir):
    """Turns of a conversation in groups of 100 subwords at most, by a tokenizer whose counts don't add up."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.concat(F.lit("Talk "), F.col("conv_id").cast("string"), F.lit("\n\n")).alias("lead"))
    x = tables.pack_texts(c, "conv_id", ["turn"], "text", "lead", 100, counters.public("word_bpe_49k.json"))
    return x.select("conv_id", "turn", "row_no", "group_no")


# --- stored records, parsed files, the engine --------------------------------------------------------------------------


def _stored(spark, sf_dir):
    """Documents as stored records: every fifth is a table's parent, every other fifth a child of one; some are there twice."""
    k = F.col("doc_id")
    kind = F.when(k % 5 == 0, "table_parent").when(k % 5 == 1, "table_child").otherwise("text")
    base = lambda x: F.format_string("d:table:%03d:parent:000", x)
    record_id = F.when(k % 5 == 0, base(k)).when(k % 5 == 1, F.format_string("d:table:%03d:child:000", k - 1)).otherwise(F.format_string("d:text:%06d", k))
    d = table(spark, sf_dir, "documents")
    d = d.select("*", F.lit(0).alias("again")).unionByName(d.where(k % 7 == 3).select("*", F.lit(1).alias("again")))
    heads = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"), F.col("lang")))
    return d.select(
        F.lit("1.0.0").alias("schema_version"), record_id.alias("record_id"), F.when(k % 5 == 1, base(k - 1)).when(k % 5 == 2, F.lit("")).alias("parent_id"), kind.alias("content_type"),
        F.struct(F.lit("d").alias("document_id"), F.array((k % 4 + 3).cast("int"), (k % 4 + 1).cast("int")).alias("pages")).alias("source"),
        F.struct(F.when(F.col("again") == 1, F.concat(F.lit("second "), "source")).otherwise(F.col("source")).alias("text"), F.when(k % 10 == 0, F.lit("")).when(k % 10 == 5, F.lit("| m |")).alias("markdown")).alias("content"),
        F.struct(F.when(k % 11 != 0, 7).alias("token_count"), heads.alias("headings"), F.when(k % 2 == 0, F.lit(" Part ")).alias("chapter"), F.when(k % 15 == 0, F.array(F.lit("Cap"))).alias("caption"), F.when(k % 5 == 1, k.cast("int")).alias("table_index")).alias("metadata"), "again", "doc_id",
    )


_RECORD_SQL = """SELECT d.doc_id, CASE WHEN doc_id % 5 = 0 THEN 'table_parent' WHEN doc_id % 5 = 1 THEN 'table_child' ELSE 'text' END AS content_type, CASE WHEN doc_id % 7 = 3 THEN 'second ' || source ELSE source END AS text FROM documents d"""


@query(f"""WITH r AS ({_RECORD_SQL}) SELECT doc_id, content_type, text, CASE WHEN doc_id % 5 = 1 THEN 'd:table:' || format('{{:03d}}', doc_id - 1) || ':parent:000' END AS parent_id, (doc_id % 4 + 1) || ',' || (doc_id % 4 + 3) AS pages, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 7 END AS token_count,
    CASE WHEN content_type = 'table_child' THEN CASE WHEN doc_id % 15 = 0 THEN 'Cap' ELSE 'Table (index ' || doc_id || ')' END WHEN content_type = 'table_parent' THEN CASE WHEN doc_id % 15 = 0 THEN 'Cap' ELSE 'Table' END
      ELSE CASE WHEN doc_id % 2 = 0 THEN 'Part > ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'Untitled section' ELSE 'A > ' || (SELECT lang FROM documents x WHERE x.doc_id = r.doc_id) END END AS title FROM r""")
def stored_records(spark, sf_dir):
    """JSON lines of stored records, read with their line numbers: of one id the last line counts."""
    path = scratch(spark)
    own = _stored(spark, sf_dir)
    own.repartitionByRange(4, "again", "doc_id").sortWithinPartitions("again", "doc_id").drop("again", "doc_id").write.option("ignoreNullFields", "false").json(path)
    r, _ = files.load_corpus(spark, path, path)
    number = F.regexp_extract("record_id", ":([0-9]+)", 1).cast("long")
    return r.select((number + F.when(F.col("content_type") == "table_child", 1).otherwise(0)).alias("doc_id"), "content_type", "text", "parent_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "token_count", "title")


@query(f"WITH r AS ({_RECORD_SQL}) SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN '| m |' ELSE text END AS text, CASE WHEN doc_id % 15 = 0 THEN 'Cap' ELSE 'Table' END AS title FROM r WHERE doc_id % 5 = 0")
def stored_parents(spark, sf_dir):
    """Parents among stored records: their text is the Markdown, unless it is null or empty."""
    path = scratch(spark)
    own = _stored(spark, sf_dir)
    own.repartitionByRange(4, "again", "doc_id").sortWithinPartitions("again", "doc_id").drop("again", "doc_id").write.option("ignoreNullFields", "false").json(path)
    _, p = files.load_corpus(spark, path, path)
    return p.select(F.regexp_extract("record_id", ":([0-9]+)", 1).cast("long").alias("doc_id"), "text", "title")


@query("SELECT 'conv-' || conv_id AS document_id, turn AS ordinal, '#/texts/' || turn AS self_ref, CASE WHEN turn % 7 = 5 THEN '#/pictures/0' WHEN turn % 7 = 6 THEN '#/texts/' || (turn - 1) ELSE '#/body' END AS parent_ref, CAST(turn + 1 AS VARCHAR) AS pages, role AS headings, CASE WHEN turn % 5 = 2 AND conv_id % 4 = 0 THEN ' Index' ELSE text END AS text FROM conversations")
def parsed_documents(spark, sf_dir):
    """Documents as files of one JSON value each, with `$ref` for references, read as items."""
    path = scratch(spark)
    x = _conversations_as_documents(spark, sf_dir).select(F.col("document_id").alias("file"), F.to_json(F.struct(F.concat(F.lit("Conv "), F.substring("document_id", 6, 20)).alias("name"), F.struct(F.col("source_filename").alias("filename")).alias("origin"), "texts", "pictures")).alias("value"))
    x.select("file", F.replace("value", F.lit('"ref"'), F.lit('"$ref"')).alias("value")).write.partitionBy("file").text(path)
    i = ingest.items(ingest.document(spark, path))
    return i.select("document_id", "ordinal", "self_ref", "parent_ref", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.array_join("headings", ",").alias("headings"), "text")


def _engine(spark, sf_dir):
    """An engine over all documents, with its index built."""
    name = F.format_string("d:text:%06d", "doc_id")
    records = table(spark, sf_dir, "documents").select(name.alias("record_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("text").alias("content_type"), F.lit("d").alias("document_id"), F.col("source").alias("title"), F.array(F.lit(2), F.lit(1)).alias("pages"), "text", F.lit(1).alias("token_count"))
    parents = records.limit(0).select("record_id", "document_id", "title", "pages", "text", F.lit(0).alias("num_rows"), F.lit(0).alias("num_cols"))
    own = Settings({"paths.index": scratch(spark)})
    e = Engine(spark, own, records, parents, models.length_embedder(own.embedding), models.lexical_reranker(), models.extractive_model())
    e.index()
    return e


_SEARCH = f"""q AS (SELECT item_id AS qid, {_strip('text')} AS question FROM benchmark WHERE {_strip('text')} <> ''), d AS (SELECT qid, question, doc_id, text, (CAST(length(question) AS DOUBLE) - length(text)) * (CAST(length(question) AS DOUBLE) - length(text)) AS d FROM q, documents),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, doc_id) AS rank FROM d) WHERE rank <= 20),
    scored AS (SELECT *, len(list_intersect({_terms('question')}, {_terms('text')})) / greatest(len({_terms('question')}), 1) AS score FROM near),
    hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rr FROM scored)"""


@query(f"WITH {_SEARCH} SELECT qid, 'd:text:' || format('{{:06d}}', doc_id) AS record_id, d AS vector_distance, round(score, 6) AS score, rr AS rank FROM hits WHERE rr <= 8")
def engine_search(spark, sf_dir):
    """Every benchmark item through the engine: index, guard, nearest 20 by the offline vectors, reranked 8."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return _engine(spark, sf_dir).search(asked, 0).select("qid", "record_id", "vector_distance", F.round("score", 6).alias("score"), F.col("rerank_rank").alias("rank"))


@query(f"""WITH {_SEARCH} SELECT qid, rr AS rank, '{{"record_id":"d:text:' || format('{{:06d}}', doc_id) || '","title":"' || (SELECT source FROM documents x WHERE x.doc_id = hits.doc_id) || '","start_page":1,"end_page":2' || CASE WHEN qid % 3 = 0 THEN '' ELSE ',"rerank_score":' || CAST(round(score * 1000) AS BIGINT) END || '}}' AS json FROM hits WHERE rr <= 8""")
def candidate_dictionaries(spark, sf_dir):
    """Candidates as dictionaries for output: a missing score has no key."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    x = _engine(spark, sf_dir).search(asked).withColumn("rerank_score", F.when(F.col("qid") % 3 != 0, F.round(F.col("score") * 1000).cast("long")))
    return x.select("qid", F.col("rerank_rank").alias("rank"), retrieval.dictionary("record_id", "title", "start_page", "end_page", "rerank_score").alias("json"))


@query(f"WITH {_SEARCH}, src AS (SELECT qid, list('d:text:' || format('{{:06d}}', doc_id) ORDER BY rr) AS ids FROM hits WHERE rr <= 4 GROUP BY qid) SELECT qid, array_to_string(ids, ',') AS cited FROM src")
def answered_stream(spark, sf_dir):
    """Questions as a stream through the engine, twice over one checkpoint: each is answered once."""
    out = scratch(spark)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    asked.write.parquet(f"{out}/questions")
    e = _engine(spark, sf_dir)
    for _ in range(2):
        streaming.answer_stream(spark.readStream.schema("qid long, question string").parquet(f"{out}/questions"), e, f"{out}/answers", f"{out}/mark", f"{out}/asked").awaitTermination()
    return spark.read.parquet(f"{out}/answers").select("qid", F.array_join(F.transform("citations", lambda c: c["record_id"]), ",").alias("cited"))


@query("SELECT doc_id, left(sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END), 16) AS content_hash, CAST(length(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS FLOAT) AS v0, source AS title FROM documents")
def index_stream(spark, sf_dir):
    """An index kept by a stream of record files: all, then every third again, changed."""
    out = scratch(spark)
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("text").alias("content_type"), F.col("source").alias("title"), F.array(F.lit(1)).alias("pages"), "text")
    store, e = index.VectorIndex(spark, f"{out}/index"), models.length_embedder()
    for rows in (r, r.where("record_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!")))):
        rows.write.mode("append").parquet(f"{out}/records")
        streaming.sync_stream(spark.readStream.schema(r.schema).parquet(f"{out}/records"), store, e, f"{out}/mark").awaitTermination()
    return store.rows().select(F.col("record_id").cast("long").alias("doc_id"), "content_hash", F.get("embedding", F.lit(0)).alias("v0"), "title")


@query("SELECT doc_id, CAST(length('passage: ' || text) AS FLOAT) AS document, CAST(length('query: ' || text) AS FLOAT) AS question, sha256('{\"document_prompt\":\"passage: \",\"max_length\":1024,\"model\":\"m\",\"normalize\":true}') AS fingerprint FROM documents")
def embed_prompted(spark, sf_dir):
    """Vectors of texts with their prompts before them; the question's prompt is no part of the fingerprint."""
    e = models.length_embedder(Settings({"embedding.model": "m", "embedding.document_prompt": "passage: ", "embedding.query_prompt": "query: "}).embedding)
    x = table(spark, sf_dir, "documents").select("doc_id", e.documents(F.col("text")).alias("d"), e.questions(F.col("text")).alias("q"))
    return x.select("doc_id", F.get("d", F.lit(0)).alias("document"), F.get("q", F.lit(0)).alias("question"), F.lit(e.fingerprint).alias("fingerprint"))


@query("SELECT r_regionkey AS key, 'Caption: ' || r_name || chr(10) || 'Caption: second' || chr(10) || '| name | ' || r_name || ' |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey) AS markdown, 'Row 1:' || chr(10) || r_name || ': yes' AS row FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def captioned_markdown(spark, sf_dir):
    g = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    shown = T.table_markdown(F.array(F.col("r_name"), F.lit("second")), F.array(F.lit("name"), F.col("r_name")), F.transform("x", lambda r: F.array(r["n_name"])))
    return g.select(F.col("r_regionkey").alias("key"), shown.alias("markdown"), T.row_text(F.lit(1), F.array(F.concat("r_name", F.lit("::")), F.lit("yes")), F.array(F.lit("a"), F.lit("b")), F.lit(True)).alias("row"))
