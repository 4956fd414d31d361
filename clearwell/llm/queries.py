"""The registered queries of this package: each applies one operator to its whole table, and the SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwell.llm.blocks import table
from clearwell.llm.chat_format import BODY, END, ESCAPES, TURN, canonical_turns, conversation_records, digest, format_turns
from clearwell.llm.language_spans import fit, held_out, identify
from clearwell.llm.latent_leaks import find_leaks
from clearwell.llm.license_scan import BASE_PHRASES, TEMPLATES, WORD, compile_template, scan_licenses, template_regex
from clearwell.llm.mixing import mix_sources
from clearwell.llm.ngram_join import ngram_join
from clearwell.llm.permutation_index import search
from clearwell.llm.phrase_mining import mine_phrases
from clearwell.llm.quality_rules import BASE as BASE_QUALITY
from clearwell.llm.quality_rules import RULES as QUALITY, judge
from clearwell.llm.secret_scan import BASE_RULES, RULES, scan_secrets
from clearwell.llm.spelling_groups import spelling_groups
from clearwell.llm.surrogates import replace_entities
from clearwell.llm.warc_archive import read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("op1_ngram_jaccard_join", rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s)
    WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach(x, y) AS (
    SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, (SELECT min(y) FROM reach WHERE x = doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _places(phrase: str) -> str:
    """Where a phrase's words stand one after another in ``ws``, from 0."""
    own = phrase.split()
    same = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(own, 1))
    return f"list_filter(range(0, greatest(0, len(ws) - {len(own) - 1})), lambda i: {same})"


def _license_sql() -> str:
    phrases = list(BASE_PHRASES.items())
    base = ", ".join(f"{_places(p)} AS p{i}" for i, (p, _) in enumerate(phrases))
    all_places = "list_concat(list_concat(p0, p1), p2)"
    base_labels = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(phrases))
    hits = ", ".join(
        f"regexp_matches(flat, '(^| ){_quoted(template_regex(markup))}') AS t{i}" for i, (_, _, markup) in enumerate(TEMPLATES))
    more = ", ".join(f"CASE WHEN t{i} THEN '{label}' END" for i, (label, _, _) in enumerate(TEMPLATES))
    sizes = [f"CASE WHEN len(p{i}) > 0 THEN {len(p.split())} END" for i, (p, _) in enumerate(phrases)]
    sizes += [f"CASE WHEN t{i} THEN {compile_template(*t).mandatory} END" for i, t in enumerate(TEMPLATES)]
    joined = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    return rf"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words, array_to_string(ws, ' ') || ' ' AS flat, {base} FROM w),
t AS (SELECT *, {all_places} AS places, {hits} FROM p),
m AS (SELECT *, list_max(list_filter([{', '.join(sizes)}], lambda x: x IS NOT NULL)) AS most FROM t)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
    {joined.format(base_labels)} AS base_labels, {joined.format(base_labels + ', ' + more)} AS labels,
    coalesce(most::DOUBLE / (most + 3), 0) AS score
FROM m
"""


@query("op2_license_templates", _license_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")


@query("op3_permutation_index")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op4_temperature_mix", rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
r AS (SELECT *, coalesce('=' || source, '') AS key FROM d WHERE n_tokens > 0),
sizes AS (SELECT key, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY 1),
shares AS (SELECT key, tokens, tokens / (SELECT sum(tokens) FROM sizes)::DOUBLE AS share FROM sizes),
aim AS (SELECT 0.98::DOUBLE * ln(count(*)) AS h, -sum(share * ln(share)) AS own FROM shares),
steps(k, low, width) AS (
    SELECT 0, 0::DOUBLE, 1::DOUBLE
    UNION ALL
    SELECT k + 1, CASE WHEN (
        SELECT ln(sum(exp((low + width / 2) * ln(share)))) - sum(exp((low + width / 2) * ln(share)) * (low + width / 2) * ln(share)) / sum(exp((low + width / 2) * ln(share)))
        FROM shares) >= (SELECT h FROM aim) THEN low + width / 2 ELSE low END, width / 2
    FROM steps WHERE k < 30),
rep(k, low, width) AS (
    SELECT 0, 0::DOUBLE, 1::DOUBLE
    UNION ALL
    SELECT k + 1, CASE WHEN (
        SELECT max(exp((low + width / 2) * ln(share)) * (SELECT sum(tokens) FROM sizes)::DOUBLE / tokens) / sum(exp((low + width / 2) * ln(share)))
        FROM shares) > 4 THEN low + width / 2 ELSE low END, width / 2
    FROM rep WHERE k < 30),
most AS (SELECT max(share * (SELECT sum(tokens) FROM sizes)::DOUBLE / tokens) AS repeats FROM shares),
a AS (
    SELECT greatest(
        CASE WHEN (SELECT own < h FROM aim) THEN (SELECT low FROM steps WHERE k = 30) ELSE 1 END,
        CASE WHEN (SELECT repeats FROM most) > 4 THEN 1 ELSE (SELECT low + width FROM rep WHERE k = 30) END)::DOUBLE AS a),
b AS (
    SELECT key, tokens, round(exp((SELECT a FROM a) * ln(share)) / (SELECT sum(exp((SELECT a FROM a) * ln(share))) FROM shares), 9) AS weight,
        greatest(1, ceil(tokens / 4096::DOUBLE))::BIGINT AS n_blocks FROM shares),
g AS (SELECT *, ceil(round(weight * (SELECT sum(tokens) FROM sizes)::DOUBLE, 3))::BIGINT AS budget FROM b),
dealt AS (
    SELECT r.*, g.weight, ('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % g.n_blocks AS block
    FROM r JOIN g USING (key)),
blocks AS (SELECT key, block, sum(n_tokens)::BIGINT AS tokens FROM dealt GROUP BY 1, 2),
turns AS (
    SELECT blocks.*, g.tokens AS all_tokens, budget, unnest(range(0, (budget - 1) // g.tokens + 1)) AS turn FROM blocks JOIN g USING (key) WHERE budget > 0),
ordered AS (SELECT *, substr(md5('mix/' || key || '/' || turn || '/' || block), 1, 15) AS perm FROM turns),
summed AS (
    SELECT *, turn * all_tokens + coalesce(sum(tokens) OVER (
        PARTITION BY key, turn ORDER BY ('0x' || substr(perm, 1, 3))::BIGINT, perm, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ordered)
SELECT doc_id, source, n_tokens, weight, turn AS pass, block, round(before::DOUBLE / budget, 9) AS place
FROM dealt JOIN summed USING (key, block) WHERE before < budget
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op5_warc_zstd", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
SELECT page_id, n AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, (i // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM h
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_latent_leaks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_language_spans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def _private_keys_sql(k: int) -> str:
    """Private keys for an engine without lookarounds: what follows each BEGIN mark is a piece of its own.

    A key line counts if a line break, a quote or the text's end follows it; a mark is put behind such runs first.
    """
    name = r"(?:[A-Z0-9]+\x20)*PRIVATE KEY(?: BLOCK)?-----"
    mark = "\ue000"
    brk = rf"(?:[\x20\t]*(?:[\r\n]|\\r{mark}?|\\n{mark}?))+[\x20\t]*"
    line = (rf"{brk}(?:Proc-Type|DEK-Info|Version|Comment|MessageID|Hash|Charset):[^\r\n\\]*"
            rf"|{brk}[A-Za-z0-9+/=]+{mark}|(?:{brk}|[\x20\t]*)[A-Za-z0-9+/=]{{16,}}{mark}?")
    marked = rf"regexp_replace(piece, '([A-Za-z0-9+/=]+)([\x20\t]*(?:[\r\n\\\"'']|$))', '\1{mark}\2', 'g')"
    return rf"""
    SELECT doc_id, place - 11 AS s, 11 + len(replace(CASE WHEN regexp_matches(piece, '^{name}(?s:.)*?-----END {name}')
        THEN regexp_extract(piece, '^{name}(?s:.)*?-----END {name}') ELSE regexp_extract({marked}, '^{name}(?:{line})*') END, '{mark}', '')) AS n, {k} AS k, 'private_key' AS kind
    FROM (
        SELECT doc_id, unnest(list_transform(range(2, len(pieces) + 1), lambda i: {{
            'piece': pieces[i], 'place': list_sum(list_transform(pieces[1:i - 1], lambda x: len(x)))::BIGINT + 11 * (i - 1)}}), recursive := true)
        FROM (SELECT doc_id, string_split(coalesce(text, ''), '-----BEGIN ') AS pieces FROM documents))
    WHERE regexp_matches(piece, '^{name}')"""


def _plain_loops(pattern: str) -> str:
    """A rule for an engine without lookbehind and possessive loops. Leftmost matches begin where a run of the first loop does,
    and each loop ends at a character that it can't take, so both say the same."""
    return re.sub(r"\(\?<![^)]*\)", "", pattern).replace("++", "+").replace("*+", "*")


def _secret_sql() -> str:
    def spans(k: int, rule) -> str:
        if rule.kind == "private_key":
            return _private_keys_sql(k)
        pattern = _quoted(("(?i)" if rule.any_case else "") + _plain_loops(rule.pattern))
        long_enough = f"len(regexp_extract(m[i], '{pattern}', {rule.group})) >= {rule.least}" if rule.least else "true"
        return f"""
    SELECT doc_id, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda i: {long_enough}), lambda i: {{
        's': list_sum(list_transform(c[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0),
        'n': len(m[i])}}), recursive := true), {k} AS k, '{rule.kind}' AS kind
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, string_split_regex(coalesce(text, ''), '{pattern}') AS c FROM documents)"""

    rules = " UNION ALL ".join(spans(k, rule) for k, rule in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES[:3])
    said = "coalesce(string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, k){}, '')"
    return f"""
WITH s AS ({rules}),
g AS (SELECT doc_id, {counts}, {said.format(' FILTER (k < 3)')} AS base, {said.format('')} AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


@query("op8_trigram_secrets", _secret_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE_RULES)))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(count(r.kind) for r in BASE_RULES),
        F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"))


def _chat_sql() -> str:
    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for plain, marked in ESCAPES:
            out = f"replace({out}, '{plain}', '{marked}')"
        return out

    return f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length({escaped('role')}) + length({escaped('text')}) + {len(TURN + BODY + END)})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op9_chat_fingerprints", _chat_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # the added conversation is a row of two, made by the engine
    added = spark.range(1).select(F.explode(F.array(*(F.struct(
        F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
        for i, role in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    records = conversation_records(rows.unionByName(added))
    return digest(format_turns(canonical_turns(records)))


@query("op10_keyed_surrogates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), key="surrogates")


@query("op11_spelling_trie", rf"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_concat([b], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
    FROM (SELECT unnest(range(0, 256)) AS b)),
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS times FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents)
    GROUP BY 1, 2),
bytes AS (
    SELECT run, times, list_transform(range(1, len(hex(encode(named))), 2), lambda i: ('0x' || substr(hex(encode(named)), i, 2))::BIGINT) AS bs FROM runs),
hashed AS (
    SELECT run, times, xor(list_reduce(list_concat([4294967295], bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM bytes, crc_table),
said AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % len(run))::BIGINT) || substr(run, (h % len(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM said WHERE len(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN cut b ON b.rest = a.word
    UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN cut b ON b.rest = a.word),
chosen AS (
    SELECT word, count(*) AS n_near, max(CASE WHEN other_n >= 2 * n THEN other_n END) AS form_n FROM near GROUP BY 1),
forms AS (
    SELECT c.word, n_near, form_n, (SELECT min(other) FROM near b WHERE b.word = c.word AND b.other_n = c.form_n) AS form FROM chosen c),
walk(word, root, step) AS (
    SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
    UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY 1)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


@query("op12_phrase_frontier", rf"""
WITH p AS (
    SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents)),
one AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM p) GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY 1),
two AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, ws[i] AS x, ws[i + 1] AS y FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM p)) GROUP BY ALL),
three AS (
    SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM p))
    GROUP BY ALL HAVING count(*) >= 10),
c3 AS (
    SELECT three.lang, x || ' ' || y || ' ' || z AS phrase, three.f AS a, o1.f AS l1, t1.f AS r1, t2.f AS l2, o2.f AS r2,
        (1000000::HUGEINT * a * a // (l1::HUGEINT * r1))::BIGINT AS s1, (1000000::HUGEINT * a * a // (l2::HUGEINT * r2))::BIGINT AS s2
    FROM three JOIN one o1 USING (lang, x) JOIN (SELECT lang, x AS y, y AS z, f FROM two) t1 USING (lang, y, z)
    JOIN two t2 USING (lang, x, y) JOIN (SELECT lang, x AS z, f FROM one) o2 USING (lang, z)),
longest AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
c2 AS (
    SELECT two.lang, x || ' ' || y AS phrase, two.f AS a, o1.f AS l, o2.f AS r, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score
    FROM two JOIN one o1 USING (lang, x) JOIN (SELECT lang, x AS y, f FROM one) o2 USING (lang, y) LEFT JOIN longest m USING (lang, x, y)
    WHERE two.f >= 10 AND (m.f IS NULL OR 100 * m.f < 50 * two.f)),
c AS (
    SELECT * FROM c2 UNION ALL
    SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM c3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    failed = lambda rules: " OR ".join(f"({r.sql})" for r in rules)
    full = lambda x: rf"regexp_matches({x}, '[^\x20\x09-\x0D]')"
    return rf"""
WITH w AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: {full('x')}) AS lines
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT doc_id, unnest(list(i)) AS i FROM grams GROUP BY doc_id, gram HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1),
m AS (
    SELECT doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[a-z]')) AS n_lower,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words
    FROM w LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({failed(BASE_QUALITY)}) AS base_failed, NOT ({failed(QUALITY)}) AS kept
FROM m
"""


@query("op13_quality_cascade", _quality_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
