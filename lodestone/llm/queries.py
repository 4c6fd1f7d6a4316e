"""The queries of this folder's operators over the synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import language_model, media, mixing, neighbours, ngram_join, odd_sketch, phrases, pieces, quality, suffix_dedup, token_output, urls
from .common import LOWER, UPPER, shared_dir, table, tokenizer_path


#: The tree and target weights that op2 and the pipeline use: three domains of sources, four languages.
MIX_WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "language": {"en": 6, "fr": 2}, "origin": {"src0": 3, "src1": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (3, 5), 2, 17


def mix_levels():
    number = F.regexp_extract("source", "([0-9]+)", 1)
    return {"domain": F.concat(F.lit("d"), F.when(number != "", number.cast("long") % 3).cast("string")), "language": F.col("lang"), "origin": F.col("source")}


def op1_sentencepiece(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_mix_sources(spark, sf_dir):
    got = mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return got.select("doc_id", "epoch", "domain", "language", "origin", "n_tokens", "leaf_budget")


def _op2_sql() -> str:
    names = ["domain", "language", "origin"]
    num, den = MIX_SHARE
    parts = [f'''base AS (SELECT doc_id, coalesce('d' || (CAST(nullif(regexp_extract(source, '([0-9]+)', 1), '') AS BIGINT) % 3), '') AS domain,
      coalesce(lang, '') AS language, coalesce(source, '') AS origin,
      CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
    sizes AS (SELECT domain, language, origin, CAST(sum(n_tokens) AS BIGINT) AS avail FROM base GROUP BY ALL),
    g0 AS (SELECT least(a * {num} // {den}, a * {MIX_EPOCHS}) AS budget FROM (SELECT CAST(coalesce(sum(avail), 0) AS BIGINT) AS a FROM sizes))''']
    for k, level in enumerate(names, 1):
        keys, family = ", ".join(names[:k]), ", ".join(names[: k - 1])
        by = f"PARTITION BY {family}" if family else ""
        weight = "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in MIX_WEIGHTS[level].items()) + " ELSE 1 END"
        order = f"{by} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {level}"
        parts.append(f'''n{k} AS (SELECT *, CAST({weight} AS BIGINT) AS weight FROM (SELECT {keys}, CAST(sum(avail) * {MIX_EPOCHS} AS BIGINT) AS cap FROM sizes GROUP BY {keys})
        {f"JOIN g{k - 1} USING ({family})" if family else "CROSS JOIN g0"}),
    m{k} AS (SELECT *, cap * CAST(sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) <= weight * (budget - CAST(sum(cap) OVER ({order} ROWS UNBOUNDED PRECEDING) - cap AS BIGINT)) AS sat FROM n{k}),
    p{k} AS (SELECT *, CAST(budget - coalesce(sum(cap) FILTER (sat) OVER ({by}), 0) AS BIGINT) AS rest, CAST(sum(weight) FILTER (NOT sat) OVER ({by}) AS BIGINT) AS every,
        CAST(coalesce(sum(weight) FILTER (NOT sat) OVER ({order} ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS sofar FROM m{k}),
    g{k} AS (SELECT {keys}, CASE WHEN sat THEN cap ELSE (rest * sofar) // every - (rest * (sofar - weight)) // every END AS budget FROM p{k})''')
    parts.append(f'''leaves AS (SELECT *, budget - f * avail AS rest FROM (SELECT *, CASE WHEN avail > 0 THEN budget // avail ELSE 0 END AS f FROM sizes JOIN g3 USING (domain, language, origin))),
    runs AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5('{MIX_SEED}:' || f || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS upto FROM base JOIN leaves USING (domain, language, origin)),
    counted AS (SELECT *, CASE WHEN (rest > 0 OR f = 0) AND upto <= rest THEN f + 1 ELSE f END AS epochs FROM runs)''')
    return "WITH " + ", ".join(parts) + " SELECT doc_id, CAST(unnest(range(epochs)) AS INTEGER) AS epoch, domain, language, origin, n_tokens, budget AS leaf_budget FROM counted"


#: Fixed values: the contract's url rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_nearest_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op4_lm_scoring(spark, sf_dir):
    return language_model.score(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    """A page is labelled if the document whose number ends its path is: bad if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)[^0-9/]*/?([?#].*)?$', 1), '') as bigint)")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    labelled = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return urls.judge(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.round("share", 9).alias("share"))


def op8_media_columns(spark, sf_dir):
    return media.digest(media.pack_texts(table(spark, sf_dir, "documents")))


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_token_id_output(spark, sf_dir):
    target = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    token_output.write(table(spark, sf_dir, "documents"), target, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_output.read(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_odd_sketch_dedup(spark, sf_dir):
    return odd_sketch.components(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    """Every run of 1 to 5 words is written out and counted; integers of 128 bits."""
    span = lambda first, last: f"array_to_string(list_slice(w, {first}, {last}), ' ')"  # noqa: E731
    runs = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: {span('i', f'i + {k - 1}')})) AS phrase FROM pieces WHERE len(w) >= {k}" for k in range(1, phrases.LONGEST + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, k, a, {c} AS cut, {span(1, c)} AS lp, {span(c + 1, 'k')} AS rp FROM c WHERE k > {c}" for c in range(1, phrases.LONGEST))
    subs = " UNION ALL ".join(f"SELECT lang, {span(i, i + m - 1)} AS phrase, a FROM c WHERE k > {m} AND k >= {i + m - 1}" for m in range(2, phrases.LONGEST) for i in range(1, phrases.LONGEST - m + 2))
    return rf"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
    split AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?
-]')) AS p FROM docs), pieces AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM split),
    f AS (SELECT lang, k, phrase, count(*) AS n FROM ({runs}) GROUP BY ALL), words AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {phrases.LEAST}), cuts AS ({cuts}),
    s AS (SELECT x.lang, x.phrase, a, l.n AS l, r.n AS r, words.n AS n, CAST((CAST({phrases.SCALE} AS HUGEINT) * a * words.n) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score, cut FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp JOIN words ON words.lang = x.lang),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s) WHERE nth = 1), inside AS (SELECT lang, phrase, max(a) AS most FROM ({subs}) GROUP BY ALL),
    kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a)
    SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= {phrases.TOP}"""


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_mix_sources, op3_nearest_neighbours, op4_lm_scoring, op5_suffix_dedup, op6_ngram_join, op7_url_filter, op8_media_columns, op9_quality_classifier, op10_token_id_output, op11_odd_sketch_dedup, op12_phrase_collocations)}
ORACLE_SQL: dict[str, str] = {"op2_mix_sources": _op2_sql(), "op12_phrase_collocations": _op12_sql()}
