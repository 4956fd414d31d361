"""Profiles, tags and the schema registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.functions.fixed_values import DEFAULT_TAG, SEMANTIC_RULES
from clearwell.operators.profile import baseline_of, profile, tag_columns
from clearwell.operators.sketches import merge_states, profile_state, state_profile
from clearwell.operators.state import confirm_drafts, latest_state, newest_first
from clearwell.plans.registered.base import Registry, gapped_events, table
from clearwell.plans.runs import DOCUMENT_SCHEMA

REGISTRY = Registry()


def tags_sql(name: str) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches({name}, '{p}') THEN '{tag}' END" for p, tag, _ in SEMANTIC_RULES)
    return f"coalesce(nullif(concat_ws(',', {hits}), ''), '{DEFAULT_TAG}')"


def description_sql(name: str) -> str:
    rules = " ".join(
        f"WHEN regexp_matches({name}, '{p}') THEN '{text} derived from column name ''' || {name} || ''''"
        for p, _, text in reversed(SEMANTIC_RULES)
    )
    return f"CASE {rules} ELSE 'Generic raw input data column: ' || {name} END"


def _column_sql(source: str, name: str, kind: str) -> str:
    numbers = (
        f"round(CAST(min({name}) AS DOUBLE), 6), round(CAST(max({name}) AS DOUBLE), 6), round(avg({name}), 4), "
        f"round(stddev_samp({name}), 4)"
        if kind in ("integer", "float")
        else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
    )
    return (
        f"SELECT '{name}', '{kind}', count(*) > count({name}), count(*), count(*) - count({name}), "
        f"count(DISTINCT {name}), {numbers} FROM {source}"
    )


def profile_sql(source: str, columns: dict[str, str], extra: str = "") -> str:
    body = " UNION ALL ".join(_column_sql(source, c, k) for c, k in columns.items())
    names = "column_name, data_type, nullable, row_count, null_count, distinct_values, min, max, mean, stddev"
    return f"WITH p({names}) AS ({body}) SELECT *{extra} FROM p"


def _rounded(df):
    digits = {"min": 6, "max": 6, "mean": 4, "stddev": 4}
    return df.drop("ordinal").withColumns({c: F.round(c, n) for c, n in digits.items()})


GAPPED_SQL = """(SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, props FROM events)"""


@REGISTRY.add(
    "profile_columns",
    profile_sql(
        GAPPED_SQL,
        {"event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "value": "float",
         "props": "string"},
        f", {tags_sql('column_name')} AS tags, {description_sql('column_name')} AS description",
    ),
)
def profile_columns(spark, sf_dir):
    """One row per column of the events table, exact distinct counts, tags and descriptions."""
    tagged = tag_columns(_rounded(profile(gapped_events(spark, sf_dir), exact=True)))
    return tagged.withColumn("tags", F.array_join("tags", ","))


LINEITEM = {
    "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
    "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
}


@REGISTRY.add("profile_numeric", profile_sql("lineitem", LINEITEM))
def profile_numeric(spark, sf_dir):
    return _rounded(profile(table(spark, sf_dir, "lineitem").select(*LINEITEM), exact=True))


@REGISTRY.add("profile_rows", "SELECT count(*) AS row_count, 11 AS columns FROM lineitem")
def profile_rows(spark, sf_dir):
    """The one-pass form with sketched distinct counts, of which only the exact parts are compared."""
    stats = profile(table(spark, sf_dir, "lineitem"))
    return stats.agg(F.max("row_count").alias("row_count"), F.count(F.lit(1)).cast("int").alias("columns"))


@REGISTRY.add(
    "date_probe",
    """
    WITH s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS iso_day, strftime(o_orderdate, '%-m/%-d/%Y') AS us_day,
                      strftime(o_orderdate, '%Y%m%d') AS packed_day, o_orderpriority AS words,
                      CASE WHEN o_orderstatus = 'F' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed
               FROM orders)
    SELECT 'iso_day' AS column_name,
           CASE WHEN bool_and(try_cast(iso_day AS TIMESTAMP) IS NOT NULL) THEN 'datetime' ELSE 'string' END AS data_type
    FROM s
    UNION ALL SELECT 'us_day', CASE WHEN bool_and(try_strptime(us_day, '%m/%d/%Y') IS NOT NULL)
                                    THEN 'datetime' ELSE 'string' END FROM s
    UNION ALL SELECT 'packed_day', CASE WHEN bool_and(try_strptime(packed_day, '%Y%m%d') IS NOT NULL)
                                        THEN 'datetime' ELSE 'string' END FROM s
    UNION ALL SELECT 'words', CASE WHEN bool_and(try_cast(words AS TIMESTAMP) IS NOT NULL)
                                   THEN 'datetime' ELSE 'string' END FROM s
    UNION ALL SELECT 'mixed', CASE WHEN bool_and(try_cast(mixed AS TIMESTAMP) IS NOT NULL)
                                   THEN 'datetime' ELSE 'string' END FROM s
    """,
)
def date_probe(spark, sf_dir):
    """Which text columns of a table hold timestamps; every cell is tried."""
    texts = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_day"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("us_day"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("packed_day"),
        F.col("o_orderpriority").alias("words"),
        F.when(F.col("o_orderstatus") == "F", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("mixed"),
    )
    return profile(texts).select("column_name", "data_type")


WORDS_SQL = """
    SELECT DISTINCT word FROM (
        SELECT unnest(regexp_split_to_array(text, '[ \\n\\t]+')) AS word FROM documents
        UNION ALL SELECT unnest(regexp_split_to_array(text, '[ \\n\\t]+')) FROM conversations
        UNION ALL SELECT replace(lower(p_name), ' ', '_') || '_id' FROM part
        UNION ALL SELECT event_type || '_timestamp' FROM events
        UNION ALL SELECT lower(c_mktsegment) || '_revenue' FROM customer)
    WHERE word <> ''"""


@REGISTRY.add(
    "semantic_tags",
    f"WITH w AS ({WORDS_SQL}) SELECT word AS column_name, {tags_sql('word')} AS tags, "
    f"{description_sql('word')} AS description FROM w",
)
def semantic_tags(spark, sf_dir):
    """Every distinct word of the texts and names in the tables, tagged as a column name."""
    split = lambda name: table(spark, sf_dir, name).select(F.explode(F.split("text", "[ \n\t]+")).alias("w"))
    words = (
        split("documents")
        .union(split("conversations"))
        .union(table(spark, sf_dir, "part").select(F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.lit("_id"))))
        .union(table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("_timestamp"))))
        .union(table(spark, sf_dir, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit("_revenue"))))
    )
    names = words.where("w <> ''").distinct().withColumnRenamed("w", "column_name")
    return tag_columns(names).withColumn("tags", F.array_join("tags", ","))


@REGISTRY.add(
    "enriched_columns",
    f"""
    WITH w AS (SELECT p_size, unnest(string_split(p_name, ' ')) AS word FROM part),
         extra AS (SELECT word, 'Word in ' || count(*) || ' large parts' AS d FROM w WHERE p_size >= 40 AND word < 'm'
                   GROUP BY word)
    SELECT n.word AS column_name, coalesce(d, {description_sql('n.word')}) AS description,
           CASE WHEN d IS NULL THEN {tags_sql('n.word')} ELSE 'PART' END AS tags
    FROM (SELECT DISTINCT word FROM w) n LEFT JOIN extra USING (word)
    """,
)
def enriched_columns(spark, sf_dir):
    """Descriptions and tags from outside win over the rules."""
    words = table(spark, sf_dir, "part").select("p_size", F.explode(F.split("p_name", " ")).alias("column_name"))
    enrichment = (
        words.where("p_size >= 40 AND column_name < 'm'").groupBy("column_name").count()
        .select("column_name",
                F.concat(F.lit("Word in "), F.col("count").cast("string"), F.lit(" large parts")).alias("description"),
                F.array(F.lit("PART")).alias("tags"))
    )
    tagged = tag_columns(words.select("column_name").distinct(), enrichment=enrichment)
    return tagged.withColumn("tags", F.array_join("tags", ","))


REGISTRATIONS = """SELECT 'tbl_' || o_custkey AS table_name, o_orderkey AS seq,
    CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'draft' END AS status, o_orderpriority AS schema_json
    FROM orders"""


def _registrations(spark, sf_dir):
    """Orders read as registration events of one table per customer."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("tbl_"), "o_custkey").alias("table_name"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("draft").alias("status"),
        F.col("o_orderpriority").alias("schema_json"))


@REGISTRY.add(
    "registry_state",
    f"""WITH e AS ({REGISTRATIONS}) SELECT table_name, seq, status, schema_json
        FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY seq DESC) AS r FROM e) WHERE r = 1""",
)
def registry_state(spark, sf_dir):
    return latest_state(_registrations(spark, sf_dir), ["table_name"], ["seq"])


@REGISTRY.add(
    "confirm_schema",
    f"""
    WITH e AS ({REGISTRATIONS}),
    d AS (SELECT table_name, arg_max(schema_json, seq) AS schema_json FROM e WHERE status = 'draft' GROUP BY table_name),
    c AS (SELECT table_name, arg_max(CASE WHEN schema_json = '1-URGENT' THEN 'override' ELSE '' END, seq) AS o
          FROM e WHERE status = 'confirmed' GROUP BY table_name)
    SELECT c.table_name, CASE WHEN d.table_name IS NULL THEN 'error' ELSE 'confirmed' END AS status,
           CASE WHEN d.table_name IS NULL THEN 'No schema found for table ''' || c.table_name || ''' to confirm.'
                ELSE coalesce(nullif(o, ''), schema_json) END AS result
    FROM c LEFT JOIN d USING (table_name)
    """,
)
def confirm_schema(spark, sf_dir):
    """Drafts confirmed in bulk, with overrides for some; confirmations without a draft are errors."""
    events = _registrations(spark, sf_dir)
    drafts = latest_state(events.where("status = 'draft'"), ["table_name"], ["seq"])
    requests = events.where("status = 'confirmed'").withColumn(
        "schema_override", F.when(F.col("schema_json") == "1-URGENT", "override"))
    confirmed, errors = confirm_drafts(drafts, requests)
    return confirmed.withColumnRenamed("schema_json", "result").unionByName(
        errors.select("table_name", F.lit("error").alias("status"), F.col("error").alias("result")))


@REGISTRY.add(
    "baseline_columns",
    """
    WITH c AS (SELECT 'tbl_' || o_custkey AS table_name, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F'
               GROUP BY 1)
    SELECT table_name, 'price' AS column_name, 'float' AS data_type, k AS distinct_values FROM c
    UNION ALL SELECT table_name, 'status', 'string', 3 FROM c
    """,
)
def baseline_columns(spark, sf_dir):
    """Confirmed schema documents (JSON) to one row per table and column."""
    document = F.concat(
        F.lit('{"table_name":"'), "table_name",
        F.lit('","columns":[{"name":"price","data_type":"float","statistics":{"distinct_values":'),
        F.col("seq").cast("string"),
        F.lit('}},{"name":"status","data_type":"string","statistics":{"distinct_values":3}}]}'))
    events = _registrations(spark, sf_dir).withColumn("schema_json", document)
    confirmed = latest_state(events.where("status = 'confirmed'"), ["table_name"], ["seq"])
    return baseline_of(confirmed.select(F.from_json("schema_json", DOCUMENT_SCHEMA).alias("d")).select("d.*"))


@REGISTRY.add(
    "newest_first",
    "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders WHERE o_orderstatus = 'F' "
    "ORDER BY o_orderdate DESC",
)
def newest_first_query(spark, sf_dir):
    return newest_first(table(spark, sf_dir, "orders"), "o_orderdate", o_orderstatus="F").select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


def checked_sketches(merged, rows):
    """A merged profile with its sketched values held against the rows: distinct values within 4 %, quartiles within 2 % of their rank."""
    exact = profile(rows, exact=True).select("column_name", F.col("distinct_values").alias("exact"))
    fine = merged.join(exact, "column_name").withColumn(
        "distinct_near", F.abs(F.col("distinct_values") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.04 * F.col("exact")))
    marks = merged.select("column_name", F.col("q1").alias("a"), F.col("median").alias("b"), F.col("q3").alias("c")).where("b is not null")
    numbers = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float")]
    cells = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in numbers]))).where("v is not null")
    # how much lies below a mark, and how much up to it
    def near(mark, p):
        return (F.count_if(F.col("v") < F.col(mark)) <= (p + 0.02) * F.count("v")) & (F.count_if(F.col("v") <= F.col(mark)) >= (p - 0.02) * F.count("v"))

    ranks = cells.join(marks, "column_name").groupBy("column_name").agg((near("a", 0.25) & near("b", 0.5) & near("c", 0.75)).alias("quartiles_near"))
    shown = _rounded(fine.join(ranks, "column_name", "left"))
    return shown.select("column_name", "data_type", "nullable", "row_count", "null_count", "min", "max", "mean", "stddev", "distinct_near", "quartiles_near")


def sketched_sql(source, columns):
    """The exact profile, and that every sketch is near."""
    numeric = ", ".join(f"'{c}'" for c, k in columns.items() if k in ("integer", "float"))
    return f"""SELECT column_name, data_type, nullable, row_count, null_count, min, max, mean, stddev, true AS distinct_near,
        CASE WHEN column_name IN ({numeric}) THEN true END AS quartiles_near FROM ({profile_sql(source, columns)})"""


EVENT_KINDS = {"event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "value": "float", "props": "string"}


@REGISTRY.add("profile_states", sketched_sql(GAPPED_SQL, EVENT_KINDS))
def profile_states(spark, sf_dir):
    """Events profiled in five uneven batches, the states merged: the sketch form of the profile."""
    events = gapped_events(spark, sf_dir)
    part = F.expr("case when user_id % 3 = 0 then 0 else user_id % 4 + 1 end")
    states = [profile_state(events.where(part == i), probe_dates=False) for i in range(5)]
    merged = states[0]
    for state in states[1:]:
        merged = merged.union(state)
    return checked_sketches(state_profile(merge_states(merged)), events)
