"""The jobs as queries over the synthetic tables: each runs twice into a new folder and gives the whole output after the second run."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobs import answers, passages
from lodestone.functions import text as T
from lodestone.plans.catalog import S, scratch

WORDS, BUDGET, RETRIEVE, RERANK, SOURCES = 120, 6000, 20, 8, 4


def job1_passages(spark, sf_dir):
    """The table may be one file or a folder of files: a pattern names either."""
    out = scratch(spark)
    for _ in range(2):
        passages.run(spark, f"{sf_dir.rstrip('/')}/documents.parque[t]", f"{out}/out", f"{out}/mark", WORDS)
    return passages.current(spark, f"{out}/out").select("record_id", "doc_id", "source", F.col("passage_no").cast("long").alias("passage_no"), "text", "n_words", "content_hash", "lang")


def job2_answers(spark, sf_dir):
    out = scratch(spark)
    at = lambda name: f"{sf_dir.rstrip('/')}/{name}.parquet"
    for _ in range(2):
        answers.run(spark, at("benchmark"), at("embeddings"), at("documents"), f"{out}/out", BUDGET, RETRIEVE, RERANK, SOURCES)
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["source_id"], c["title"], c["pages"], c["record_id"])), "\n")
    return answers.current(spark, f"{out}/out").select("item_id", "language", "question", "prompt", cited.alias("citations"), F.array_join("truncated", ",").alias("truncated"), F.col("prompt_chars").cast("long").alias("prompt_chars"), "answer", "model")


_PASSAGES = f"""WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce(lang, 'und') AS lang, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    lines AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS t FROM docs), w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(t, '{S}+'), lambda x: x <> '') AS w FROM lines),
    parts AS (SELECT doc_id, line, w, unnest(range((len(w) + {WORDS - 1}) // {WORDS})) AS part FROM w),
    items AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, part) AS r, array_to_string(list_slice(w, part * {WORDS} + 1, part * {WORDS} + {WORDS}), ' ') AS t, least({WORDS}, len(w) - part * {WORDS}) AS n FROM parts),
    g(doc_id, r, g, s) AS (SELECT doc_id, r, CAST(1 AS BIGINT), n FROM items WHERE r = 1 UNION ALL
      SELECT i.doc_id, i.r, CASE WHEN g.s + i.n > {WORDS} THEN g.g + 1 ELSE g.g END, CASE WHEN g.s + i.n > {WORDS} THEN i.n ELSE g.s + i.n END FROM g JOIN items i ON i.doc_id = g.doc_id AND i.r = g.r + 1),
    p AS (SELECT doc_id, g AS passage_no, string_agg(t, chr(10) ORDER BY r) AS text, CAST(sum(n) AS BIGINT) AS n_words FROM g JOIN items USING (doc_id, r) GROUP BY ALL)
    SELECT doc_id || ':text:' || format('{{:06d}}', passage_no) AS record_id, doc_id, source, passage_no, text, n_words, left(sha256(text), 16) AS content_hash, lang FROM p JOIN docs USING (doc_id)"""

def _terms(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '{S}+'), lambda x: x <> ''))"


_N, _NOTE = len(T.NOTE), T.NOTE.replace("\n", "' || chr(10) || '")

_ANSWERS = f"""WITH RECURSIVE asked AS (SELECT item_id, regexp_replace(text, '^{S}+|{S}+$', '', 'g') AS question FROM benchmark WHERE regexp_replace(text, '^{S}+|{S}+$', '', 'g') <> ''),
    d AS (SELECT q.vec_id AS item_id, c.vec_id AS doc_id, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)))) AS d FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT item_id FROM asked)),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d, doc_id) AS rank FROM d) WHERE rank <= {RETRIEVE}),
    found AS (SELECT n.item_id, n.rank, question, doc_id, text, source, len(list_intersect({_terms('question')}, {_terms('text')})) / greatest(len({_terms('question')}), 1) AS score FROM near n JOIN documents USING (doc_id) JOIN asked USING (item_id)),
    src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC NULLS LAST, rank) AS no FROM found) WHERE no <= {SOURCES}),
    b AS (SELECT item_id, no, doc_id, text AS section, coalesce(source, 'document') || ' ' || doc_id AS title, '[Source ' || no || '] ' || coalesce(source, 'document') || ' ' || doc_id || ' (pages 1)' || chr(10) AS head FROM src),
    fold(item_id, no, room, body, cites, cuts, open) AS (SELECT item_id, CAST(0 AS BIGINT), CAST({BUDGET} AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), true FROM asked UNION ALL
      SELECT item_id, no + 1, CASE WHEN ok THEN room - length(block) ELSE 0 END, CASE WHEN ok THEN list_append(body, block) ELSE body END, CASE WHEN ok THEN list_append(cites, cite) ELSE cites END, CASE WHEN ok AND over THEN list_append(cuts, rid) ELSE cuts END, ok FROM (
        SELECT f.*, f.open AND f.room > 0 AND length(b.head) < f.room AS ok, length(b.section) > f.room - length(b.head) AS over, CAST(b.doc_id AS VARCHAR) AS rid, 'Source ' || b.no || '|' || b.title || '|p. 1|' || b.doc_id AS cite,
          b.head || CASE WHEN length(b.section) <= f.room - length(b.head) THEN b.section WHEN f.room - length(b.head) <= {_N} THEN left('{_NOTE}', greatest(f.room - length(b.head), 0))
            ELSE regexp_replace(left(b.section, CAST(f.room - length(b.head) - {_N} AS BIGINT)), '{S}+$', '') || '{_NOTE}' END AS block FROM fold f JOIN b ON b.item_id = f.item_id AND b.no = f.no + 1)),
    done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY no DESC) AS last FROM fold) WHERE last = 1),
    made AS (SELECT item_id, CASE WHEN regexp_matches(question, '{T.CJK}') THEN 'zh-hant' ELSE 'en' END AS language, question, cites, cuts,
      'Use only the sources below and name them as [Source N]. ' || CASE WHEN regexp_matches(question, '{T.CJK}') THEN 'Answer in Traditional Chinese.' ELSE 'Answer in English.' END || chr(10) || chr(10) || 'Sources:' || chr(10) || chr(10) || array_to_string(body, chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' AS prompt FROM done JOIN asked USING (item_id)),
    said AS (SELECT *, list_filter(list_transform((string_split(substr(prompt, strpos(prompt, '[Source 1]') + 10), chr(10)))[2:], lambda x: regexp_replace(x, '^{S}+|{S}+$', '', 'g')), lambda x: x <> '') AS ls FROM made)
    SELECT item_id, language, question, prompt, array_to_string(cites, chr(10)) AS citations, array_to_string(cuts, ',') AS truncated, length(prompt) AS prompt_chars, CASE WHEN strpos(prompt, '[Source 1]') = 0 OR len(ls) = 0 THEN 'No source says.' ELSE ls[1] || ' [Source 1]' END AS answer, 'extractive' AS model FROM said"""

QUERIES = {f.__name__: f for f in (job1_passages, job2_answers)}
ORACLE_SQL = {"job1_passages": _PASSAGES, "job2_answers": _ANSWERS}
