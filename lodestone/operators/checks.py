"""Data-quality rules: each a named predicate of a bad row; all are counted in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.errors import ConfigurationError, CorpusError
from lodestone.functions.text import strip
from lodestone.operators.corpus import orphans
from lodestone.operators.tables import consecutive, coverage
from lodestone.stage import stash

Rules = dict[str, Column]


def envelope_rules() -> Rules:
    """The stored record's schema, rule by rule, for rows that ENVELOPE has parsed."""
    c = F.col
    pages = c("source.pages")
    return {
        "schema_version": ~c("schema_version").eqNullSafe(F.lit(schemas.SCHEMA_VERSION)),
        "record_id": ~F.coalesce(c("record_id").rlike(r"^[A-Za-z0-9._-]+:(text|table):[0-9]{3,}(:(parent|child):[0-9]{3,})?$"), F.lit(False)),
        "content_type": ~F.coalesce(c("content_type").isin(*schemas.CONTENT_TYPES), F.lit(False)),
        "pages": ~F.coalesce((F.size(pages) > 0) & F.forall(pages, lambda p: p >= 1) & (F.size(F.array_distinct(pages)) == F.size(pages)), F.lit(False)),
        "text": ~F.coalesce(F.length("content.text") > 0, F.lit(False)),
        "child_parent": (c("content_type") == "table_child") & (F.coalesce(c("parent_id"), F.lit("")) == ""),
        "no_parent": c("content_type").isin("text", "table_parent") & c("parent_id").isNotNull(),
    }


def record_rules(limit: int) -> Rules:
    """What holds for any chunk: text, tokens (a missing count is over the limit), pages."""
    return {
        "empty_text": strip(F.coalesce("text", F.lit(""))) == "",
        "over_limit": F.coalesce("token_count", F.lit(limit + 1)) > limit,
        "no_pages": F.coalesce(F.size("pages"), F.lit(0)) < 1,
    }


#: Where a stored record keeps what the rules of chunks speak of.
FIELDS = {"text": "content.text", "token_count": "metadata.token_count", "pages": "source.pages", "refs": "source.locators.refs", "headings": "metadata.headings"}
#: What an error of write_checked() begins with, inside Spark's own message.
BROKEN = "broken rule: "


def text_rules(limit: int) -> Rules:
    """Chunks of running text also name their items, none of a table or picture, and aren't the index."""
    return record_rules(limit) | {
        "no_refs": F.coalesce(F.size("refs"), F.lit(0)) < 1,
        "table_refs": F.exists("refs", lambda r: r.startswith("#/tables/") | r.startswith("#/pictures/")),
        "navigation": F.exists("headings", lambda h: F.lower(strip(h)) == "index"),
    }


def text_counts(limit: int) -> Rules:
    """What is counted for a report: rows that break a rule, but every ref to a table or picture."""
    return text_rules(limit) | {"table_refs": F.size(F.filter("refs", lambda r: r.startswith("#/tables/") | r.startswith("#/pictures/")))}


def combined_rules(limit: int) -> Rules:
    """What each record of the joint corpus must be, besides its schema, for rows that ENVELOPE has parsed."""
    return {
        "content_type": ~F.coalesce(F.col("content_type").isin("text", "table_child"), F.lit(False)),
        "empty_text": strip(F.coalesce("content.text", F.lit(""))) == "",
        "over_limit": F.coalesce("metadata.token_count", F.lit(limit + 1)) > limit,
    }


def combined_figures(records: DataFrame, parents: DataFrame, limit: int) -> DataFrame:
    """One row of what the joint corpus holds and breaks: records, text_records, table_child_records, duplicate_ids, the counts of
    combined_rules(), tokenizers, documents (distinct values, null counts as one), invalid_parent_links, schema_errors."""
    rules, schema = combined_rules(limit), envelope_rules()
    wrong = F.array_max(F.array(*(bad.cast("int") for bad in schema.values())))
    kinds = F.col("content_type")
    per_id = records.groupBy("record_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_ids"))
    values = lambda c: F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")))
    one = records.agg(
        F.count("*").alias("records"), F.count_if(kinds == "text").alias("text_records"), F.count_if(kinds == "table_child").alias("table_child_records"), *(F.count_if(bad).alias(name) for name, bad in rules.items()),
        values("metadata.tokenizer_name").alias("tokenizers"), F.count_if(F.col("metadata.tokenizer_name").isNull()).alias("no_tokenizer"), values("source.document_id").alias("documents"),
        F.count_if(F.col("source.document_id").isNull()).alias("no_document"), F.coalesce(F.sum(wrong), F.lit(0)).alias("schema_errors"),
    )
    links = orphans(records, parents).agg(F.count("*").alias("invalid_parent_links"))
    return one.join(per_id, F.lit(True)).join(links, F.lit(True))  # one row each


def validate_combined(records: DataFrame, parents: DataFrame, limit: int) -> dict:
    """The figures of a corpus that can be used; raises with what is wrong and up to five of the records it is wrong with."""
    got = combined_figures(records, parents, limit).first().asDict()
    if not got["records"]:
        raise CorpusError("there are no records")
    if got["duplicate_ids"]:
        bad = records.groupBy("record_id").count().where("count > 1").orderBy("record_id").limit(5).collect()
        raise CorpusError(f"ids are there twice: {[r.record_id for r in bad]}")
    require(records, combined_rules(limit), "record_id")
    for what in ("tokenizer", "document"):
        if got[f"{what}s"] != 1 or got[f"no_{what}"]:
            raise CorpusError(f"records are of {got[f'{what}s']} {what}s, {got[f'no_{what}']} of them name none")
    if got["invalid_parent_links"]:
        bad = orphans(records, parents).orderBy("record_id").limit(5).collect()
        raise CorpusError(f"parents are missing: {[(r.record_id, r.parent_id) for r in bad]}")
    require(records, envelope_rules(), "record_id")
    return got


def validate_children(children: DataFrame, packed: DataFrame, expected: DataFrame, numbers: DataFrame) -> None:
    """Raises unless children hold their rows' pairs, each expected row is packed once, and fragments count from 1 without gaps.
    packed, expected: key, row_no; numbers: key, fragment_no."""
    require(children, child_rules(), "record_id")
    validate_coverage(packed, expected, numbers)


def validate_coverage(packed: DataFrame, expected: DataFrame, numbers: DataFrame) -> None:
    for what, bad in (("rows are missing or there twice", coverage(packed, expected, "key")), ("fragments don't follow each other", consecutive(numbers, "key", "fragment_no"))):
        if found := bad.where("not ok").orderBy("key").limit(5).collect():
            raise CorpusError(f"{what}: {[r.key for r in found]}")


def require_parameters(target: int, limit: int) -> None:
    if not 0 < target <= limit:
        raise ConfigurationError(f"a chunk's target must be from 1 to its limit, not {target} of {limit}")


def require_inputs(spark: SparkSession, *paths: str) -> None:
    """Raises with the inputs that no store has."""
    missing = []
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            missing.append(p)
    if missing:
        raise CorpusError(f"there is no {', no '.join(missing)}")


def child_rules() -> Rules:
    """Table children hold each of their rows' pairs; fragments are exempt."""
    return {"pairs": ~F.col("is_fragment") & F.exists("pairs", lambda p: ~F.contains("text", p))}


def stored_child_rules() -> Rules:
    """child_rules() over a stored record: each filled cell of its rows stands in its text beside its column's name, or its key."""
    text, s = F.col("content.text"), F.col("content.structured")
    there = lambda a, b: F.contains(text, F.concat(a, F.lit(": "), b))
    named = lambda r: F.exists(F.zip_with(s["header"], r["values"], lambda h, v: (v != "") & ~there(h, v)), lambda x: F.coalesce(x, F.lit(False)))
    single = lambda r: ~there(strip(F.regexp_replace(F.get(r["values"], F.lit(0)), ":+$", "")), F.get(r["values"], F.lit(1)))
    kv = F.col("metadata.embedding_serialization") == "key_value_v1"
    return {"pairs": s["row_fragment"].isNull() & F.exists(s["rows"], lambda r: F.when(kv, single(r)).otherwise(named(r)))}


def prefixed(prefix: str, rules: Rules) -> Rules:
    return {prefix + name: bad for name, bad in rules.items()}


def marked(df: DataFrame, rules: Rules, fields: dict[str, str] | None = None) -> DataFrame:
    """Adds broken: the names of the rules that a row breaks. fields: columns that the rules use and df keeps elsewhere."""
    x = df.withColumns({name: F.col(at) for name, at in (fields or {}).items()})
    return x.withColumn("broken", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))).drop(*(fields or {}))


def write_checked(df: DataFrame, path: str, rules: Rules, key: str, quarantine: str | None = None, order: list[str] | None = None, fields: dict[str, str] | None = None) -> dict:
    """Writes rows as JSON lines and checks them in the job that writes; gives `records` written, `quarantined` rows, and rows by rule.

    Without a quarantine the first broken row ends the job: a CorpusError, and nothing stands at the path. With one, broken rows go there with
    the names of their rules (`broken`), the others to the path; rows are made once. Figures are observed on what is written. order: how rows lie in the files."""
    x = marked(df, rules, fields)
    seen = Observation()
    bad = F.size("broken") > 0
    figures = [F.count_if(~bad).alias("records"), F.count_if(bad).alias("quarantined"), *(F.count_if(F.array_contains("broken", name)).alias(name) for name in rules)]
    place = lambda rows: rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    put = lambda rows, to: rows.write.mode("overwrite").option("ignoreNullFields", "false").json(to)
    if quarantine is None:
        holds = F.when(bad, F.raise_error(F.concat(F.lit(BROKEN), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), F.element_at("broken", 1), F.lit("\n"))).cast("boolean")).otherwise(F.lit(True))
        try:
            put(place(x.observe(seen, *figures).where(holds).select(*df.columns)), path)  # no filter moves below what is observed: only rows that would be written are checked
        except Exception as e:
            if BROKEN not in str(e):
                raise
            raise CorpusError(str(e).split(BROKEN, 1)[1].split("\n")[0]) from e
        return seen.get
    made = stash(x.observe(seen, *figures), "checked")
    put(place(made.where(~bad).select(*df.columns)), path)
    put(made.where(bad), quarantine)
    return seen.get


def view_rules(start: int, index_start: int | None) -> Rules:
    """The text view, stricter than its filter: no item starts before the first page."""
    first, last = F.array_min("pages"), F.array_max("pages")
    rules = {"label": F.col("label").isin("caption", "page_footer", "page_header"), "dangling": F.coalesce(F.col("parent_ref").rlike("^#/(tables|pictures)/"), F.lit(False)), "before": F.coalesce(first < start, F.lit(False))}
    return rules | ({"after": F.coalesce(last >= index_start, F.lit(False))} if index_start is not None else {})


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """rule, n of all rules, from one pass over df: rows that break it, or the sum of what a rule counts."""
    one = df.agg(*(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias(name) for name, bad in rules.items()))
    return one.select(F.stack(F.lit(len(rules)), *(x for name in rules for x in (F.lit(name), F.col(name)))).alias("rule", "n"))


def broken(df: DataFrame, rules: Rules, key: str) -> DataFrame:
    """key, rule of each row that breaks a rule."""
    names = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return df.select(key, F.explode(names).alias("rule"))


def require(df: DataFrame, rules: Rules, key: str) -> None:
    """Raises with the first five that break a rule."""
    if bad := broken(df, rules, key).orderBy(key, "rule").limit(5).collect():
        raise CorpusError("; ".join(f"{r[0]}: {r[1]}" for r in bad))
