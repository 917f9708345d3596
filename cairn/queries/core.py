"""Queries of the engine's own operators and of the general data problems, and the SQL they are compared with."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import answers, check, entities, nested, records, retrieve, scan, schema_drift, store
from cairn.operators.nested import label_trees, run_tables
from cairn.plans import algebra
from cairn.queries import sql
from cairn.session import checkpointed, table
from cairn.streaming import learn

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW = datetime(2026, 12, 1)


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return put


# ---- shared inputs ----------------------------------------------------------------------------------------------


def sentences(s: SparkSession, d: str) -> DataFrame:
    return store.sentence_rows(table(s, d, "documents"))


def lines(s: SparkSession, d: str) -> DataFrame:
    return store.with_sid(sentences(s, d))


def graph(s: SparkSession, d: str) -> DataFrame:
    """Memory records as the graph operators read them, each repeated row once."""
    return table(s, d, "dynamics").filter("subject is not null and predicate is not null and value_text is not null").select(
        "record_key", "subject", "predicate", F.lower(F.trim("value_text")).alias("value"), "source", "level", "trust", "witnesses",
        F.col("stated_at").cast("timestamp").alias("at"), F.col("last_seen").cast("timestamp").alias("last_seen"), "episodic", "unit",
    ).distinct()


def sound(s: SparkSession, d: str) -> DataFrame:
    return graph(s, d).filter(F.col("trust").between(0, 1) & ~F.isnan("trust"))


def asked(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: the different questions of pairs whose id is divisible by 20."""
    q = table(s, d, "gate_blame").filter("pair_id % 20 = 0 and question is not null").groupBy("question").agg(F.min("pair_id").alias("query_id"))
    return q.select("query_id", F.col("question").alias("query"))


ASKED = "q AS (SELECT min(pair_id) AS query_id, question AS query FROM gate_blame WHERE pair_id % 20 = 0 AND question IS NOT NULL GROUP BY question)"


def dated(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("sid"), F.to_date("ts").alias("day"), F.concat_ws(" ", "event_type", F.lit("by reader"), F.col("user_id").cast("string")).alias("sentence"), F.col("value").alias("amount"))


DATED = "l AS (SELECT event_id AS sid, CAST(ts AS DATE) AS day, event_type, value AS amount, user_id FROM events)"

# ---- text ---------------------------------------------------------------------------------------------------------


@query("fold_words", f"WITH k AS (SELECT doc_id, {sql.tokens('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(t) AS n_tokens, array_to_string({sql.content('t')}, ' ') AS words FROM k")
def fold_words(s, d):
    docs = tx.composed(table(s, d, "documents").select("doc_id", "text").filter("text is not null"), "text")
    t = docs.select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(tx.content(F.col("t")), " ").alias("words"))


@query("sentence_split", "WITH" + sql.sentences(".!?") + " SELECT doc_id, pos, sentence FROM s")
def sentence_split(s, d):
    return store.sentence_rows(table(s, d, "documents"), marks=".!?").select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query("source_stamps", r"""
WITH a AS (SELECT source FROM documents WHERE source IS NOT NULL UNION SELECT source FROM dynamics WHERE source IS NOT NULL),
n AS (SELECT source, CASE WHEN source LIKE '%:%' THEN regexp_replace(source, '^[^:]*:', '') ELSE regexp_replace(source, '^#+', '') END AS nm, regexp_extract_all(source, '\d+') AS p FROM a)
SELECT source, regexp_replace(nm, '([^.])\.[^.]*$', '\1') AS name, CASE WHEN len(p) >= 3 THEN try_cast(lpad(p[1], 4, '0') || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[3], 2, '0') AS DATE) END AS day FROM n""")
def source_stamps(s, d):
    a = table(s, d, "documents").select("source").union(table(s, d, "dynamics").select("source")).filter("source is not null").distinct()
    return a.select("source", tx.source_name(F.col("source")).alias("name"), tx.stamp_day(F.col("source")).alias("day"))


@query("quantity_units_learned", r"""
WITH v AS (SELECT DISTINCT record_key, value_text FROM dynamics WHERE value_text IS NOT NULL),
x AS (SELECT regexp_extract_all(value_text, '\d+(?:[.,]\d+)?|[\p{L}]+|[^\w\s]+') AS r FROM v),
y AS (SELECT r, unnest(range(1, len(r) + 1)) AS i FROM x),
z AS (SELECT lower(r[i]) AS token, (i > 1 AND regexp_matches(coalesce(r[i-1], ''), '^\d')) OR regexp_matches(coalesce(r[i+1], ''), '^\d') AS beside FROM y WHERE NOT regexp_matches(r[i], '^\d'))
SELECT token, count(*) AS n, sum(CAST(beside AS INT)) AS beside FROM z GROUP BY token HAVING 2 * sum(CAST(beside AS INT)) > count(*)""")
def quantity_units_learned(s, d):
    rows = table(s, d, "dynamics").select("record_key", "value_text").distinct().filter("value_text is not null")
    return store.learned_quantities(rows, "value_text", longest=None).select("token", "n", F.col("beside").cast("long").alias("beside"))


@query("measures", r"""
WITH v AS (SELECT DISTINCT value_text FROM dynamics WHERE value_text IS NOT NULL),
m AS (SELECT value_text, regexp_extract(value_text, '(\d+(?:[.,]\d+)?)[ \t]?([^\s\d]{1,4})?', ['n', 'u']) AS p FROM v WHERE regexp_matches(value_text, '\d'))
SELECT value_text, CAST(replace(p.n, ',', '.') AS DOUBLE) AS low, CAST(replace(p.n, ',', '.') AS DOUBLE) AS high, CASE WHEN p.u <> '' THEN lower(p.u) END AS unit FROM m""")
def measures(s, d):
    v = table(s, d, "dynamics").select("value_text").filter("value_text is not null").distinct()
    return v.withColumn("m", tx.measure(F.col("value_text"))).filter("m.low is not null").select("value_text", "m.low", "m.high", "m.unit")


@query("markup_share", r"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '<[^<>\s][^<>]*>', '', 'g'))) / length(text) ELSE 0 END, 9) AS share FROM documents WHERE text IS NOT NULL")
def markup_share(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.round(tx.markup_share(F.col("text")), 9).alias("share"))


@query("window_scales", "WITH" + sql.sentences() + """,
a AS (SELECT doc_id, source, parts, len(parts) AS n FROM e WHERE len(parts) > 0),
b AS (SELECT *, unnest([3, 6, 12]) AS size FROM a), c AS (SELECT *, unnest(range(n)) AS start FROM b),
x AS (SELECT doc_id, source, size, start, parts[start + 1] AS first_one, array_to_string(list_slice(parts, start + 1, start + size), ' ') AS w FROM c
      WHERE start = 0 OR (start % greatest(2, size // 3) = 0 AND start <= n - size))
SELECT doc_id, source, size, start, w AS "window" FROM x WHERE length(w) > length(first_one)""")
def window_scales(s, d):
    return store.windows(sentences(s, d)).withColumn("start", F.col("start").cast("long"))


@query("dedup_sentences", "WITH" + sql.sentences() + f""",
f AS (SELECT *, row_number() OVER (PARTITION BY {sql.fold('sentence')}, source ORDER BY doc_id, pos) AS n FROM s)
SELECT doc_id, source, pos, sentence FROM f WHERE n = 1""")
def dedup_sentences(s, d):
    return store.deduplicated(sentences(s, d)).select("doc_id", "source", F.col("pos").cast("long").alias("pos"), "sentence")


@query("cell_bound_otsu", r"""
WITH l AS (SELECT coalesce(source, '') AS source, unnest(string_split_regex(text, '\r?\n')) AS line FROM documents WHERE text IS NOT NULL),
c AS (SELECT source, length(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS l, count(*) AS n FROM l WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1, 2),
r AS (SELECT source, l, sum(n) OVER w AS n1, sum(n * l) OVER w AS s1, sum(n) OVER (PARTITION BY source) AS n, sum(n * l) OVER (PARTITION BY source) AS s FROM c WINDOW w AS (PARTITION BY source ORDER BY l)),
k AS (SELECT source, l, round(CAST(n1 * (n - n1) AS DOUBLE) * pow(CAST(s1 AS DOUBLE) / n1 - CAST(s - s1 AS DOUBLE) / (n - n1), 2), 6) AS score FROM r WHERE n1 < n)
SELECT source, l AS bound FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, l) AS p FROM k) WHERE p = 1""")
def cell_bound_otsu(s, d):
    l = table(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    rows = store.line_rows(table(s, d, "documents")).join(l, "doc_id").withColumn("len", F.length("line"))
    return store.otsu_bound(rows, "source", "len")


@query("index_column_runs", r"""
WITH a AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM a),
c AS (SELECT doc_id, pos, CAST(nullif(regexp_extract(line, '\s(\d{1,5})\s*$', 1), '') AS INT) AS n FROM b),
e AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c),
f AS (SELECT *, sum(CASE WHEN n IS NULL OR before IS NULL OR n < before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM e)
SELECT doc_id, min(pos) AS start, count(*) AS lines FROM f WHERE n IS NOT NULL GROUP BY doc_id, run HAVING count(*) >= 3 AND min(n) < max(n)""")
def index_column_runs(s, d):
    return store.locator_runs(store.line_rows(table(s, d, "documents"))).withColumn("start", F.col("start").cast("long"))


@query("region_of_answer", f"""
WITH p AS (SELECT DISTINCT pair_id, question, said FROM gate_blame WHERE question IS NOT NULL AND said IS NOT NULL),
k AS (SELECT pair_id, {sql.tokens('question')} AS a, {sql.tokens('said')} AS b FROM p),
w AS (SELECT pair_id, list_distinct({sql.content('a')}) AS x, list_distinct({sql.content('b')}) AS y FROM k),
n AS (SELECT pair_id, len(list_intersect(x, y)) AS c, len(list_distinct(list_concat(x, y))) AS u, least(len(x), len(y)) AS m FROM w)
SELECT pair_id, c > 0 AND (c / greatest(u, 1) > 0.5 OR c / greatest(m, 1) > 0.5) AS same FROM n""")
def region_of_answer(s, d):
    p = table(s, d, "gate_blame").select("pair_id", "question", "said").distinct().filter("question is not null and said is not null")
    for c in ("question", "said"):
        p = tx.composed(p, c)
    w = lambda c: F.array_distinct(tx.words(F.col(c)))
    return p.select("pair_id", tx.same_region(w("question"), w("said")).alias("same"))


@query("record_pairs")
def record_pairs(s, d):
    rows = sentences(s, d)
    return rows.select("doc_id", "pos", F.explode(tx.record_pairs(F.col("sentence"))).alias("p")).select("doc_id", "pos", "p.head", "p.value")


@query("table_records")
def table_records(s, d):
    return store.table_records(store.line_rows(table(s, d, "documents")))


@query("front_matter")
def front_matter(s, d):
    return store.front_matter(store.line_rows(table(s, d, "documents")))


@query("field_heads")
def field_heads(s, d):
    return store.fields(sentences(s, d))


# ---- store and retrieval --------------------------------------------------------------------------------------------


@query("inverted_index_df", "WITH" + sql.STORE + ", n AS (SELECT count(*) AS n FROM s) SELECT word, count(*) AS df, round(ln(1 + max(n.n) / count(*)), 6) AS idf FROM post, n GROUP BY word")
def inverted_index_df(s, d):
    rows = lines(s, d)
    df = store.document_frequency(store.postings(rows))
    return df.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))), F.lit(True)).select("word", "df", F.round(F.log(1 + F.col("n") / F.col("df")), 6).alias("idf"))


_BLANK, _WORD = r"[\s\p{Z}]", r"\p{L}\p{N}_\"''."
_NAME = r"regexp_replace(CASE WHEN source LIKE '%:%' THEN regexp_replace(source, '^[^:]*:', '') ELSE regexp_replace(source, '^#+', '') END, '([^.])\.[^.]*$', '\1')"
#: Field names, groups of query words, the bonus of source names: the whole of AG-02 .. AG-04 and RK-02, RK-03.
_FIND = "WITH" + sql.STORE + rf""", {ASKED},
kb AS (SELECT list_sort(list(length(sentence)))[count(*) // 2 + 1] AS chars, list_sort(list(len(t)))[count(*) // 2 + 1] AS toks FROM t),
kn AS (SELECT sid, source, sentence, {sql.content('t')} AS held FROM t WHERE regexp_matches(sentence, '[:\p{{Nd}}]')),
kh AS (SELECT sid, source, held, unnest(regexp_extract_all(replace(sentence, ':', ': '), '(?:^|[^{_WORD}])((?:[{_WORD}]+[ \t]+){{0,2}}[{_WORD}]+){_BLANK}*:', 1)) AS name, NULL AS segment FROM kn),
ks AS (SELECT sid, source, held, unnest(list_filter(list_transform(string_split_regex(sentence, '[·—;|]'), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: regexp_matches(x, '\p{{Nd}}'))) AS segment FROM kn),
ka AS (SELECT * FROM kh UNION ALL SELECT sid, source, held, regexp_extract(segment, '^([^\p{{Nd}}:]+?){_BLANK}*\p{{Nd}}', 1), segment FROM ks),
kt AS (SELECT sid, source, held, segment, {sql.tokens('name')} AS nt, CASE WHEN segment IS NOT NULL THEN {sql.tokens('segment')} END AS st FROM ka WHERE name <> ''),
kp AS (SELECT *, list_position(list_transform(st, lambda x: {sql.number('x')}), true) - 1 AS first_number FROM kt),
kf AS (SELECT sid, source, held, {sql.content('nt')} AS w FROM kp, kb WHERE segment IS NULL OR (length(segment) <= kb.chars AND len(st) <= kb.toks AND first_number > 0 AND 2 * first_number <= len(st))),
keys AS (SELECT DISTINCT sid, source, unnest(list_intersect(list_filter(list_slice(w, greatest(len(w) - 2, 1), len(w)), lambda x: NOT {sql.number('x')}), held)) AS word FROM kf),
qt AS (SELECT query_id, {sql.tokens('query')} AS t FROM q),
qw AS (SELECT query_id, unnest(list_distinct({sql.content('t')})) AS word FROM qt),
rt AS (SELECT a.query_id, a.word, min(b.word) AS root FROM qw a JOIN qw b ON a.query_id = b.query_id AND starts_with(a.word, b.word) GROUP BY 1, 2),
voc AS (SELECT DISTINCT word FROM post),
terms AS (SELECT DISTINCT query_id, root, voc.word AS term FROM rt JOIN voc ON left(rt.word, 3) = left(voc.word, 3) AND {sql.stem('rt.word', 'voc.word', 3)}),
hits AS (SELECT query_id, root, sid, source, max(times) AS times FROM terms JOIN (SELECT word, sid, source, 1 AS times FROM post UNION ALL SELECT word, sid, source, 2 FROM keys) ON term = word GROUP BY 1, 2, 3, 4),
held AS (SELECT query_id, root, count(DISTINCT sid) AS held FROM hits GROUP BY 1, 2),
len AS (SELECT sid, len(words) AS n, length(sentence) AS chars FROM w), tot AS (SELECT count(*) AS n, avg(n) AS mean FROM len),
wt AS (SELECT query_id, root, ln(1 + tot.n / held) AS weight FROM held, tot),
sc AS (SELECT query_id, sid, source, sum(weight * times) AS weight FROM hits JOIN wt USING (query_id, root) GROUP BY 1, 2, 3),
rk AS (SELECT query_id, sid, source, chars, round(weight / (0.8 + 0.2 * greatest(len.n, 1) / tot.mean), 6) AS score FROM sc JOIN len USING (sid), tot),
fl AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM rk) WHERE score >= 0.5 * best),
sn AS (SELECT DISTINCT source FROM s), st AS (SELECT source, {sql.tokens(_NAME)} AS t FROM sn), sw AS (SELECT source, unnest(list_distinct({sql.content('t')})) AS word FROM st),
sb AS (SELECT word, ln((SELECT count(*) FROM sn) / count(*)) AS bonus FROM sw GROUP BY word HAVING count(*) < (SELECT count(*) FROM sn)),
bn AS (SELECT query_id, source, sum(bonus) AS bonus FROM qw JOIN sw USING (word) JOIN sb USING (word) GROUP BY 1, 2),
nm AS (SELECT query_id, sid, source, chars, round(score + coalesce(bonus, 0), 6) AS score FROM fl LEFT JOIN bn USING (query_id, source))
"""


@query("find_topk", _FIND + "SELECT query_id, sid, source, score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chars DESC, sid) AS n FROM nm) WHERE n <= 6")
def find_topk(s, d):
    best = scan.best_lines(checkpointed(lines(s, d)), asked(s, d), 6)
    return best.select("query_id", "sid", "source", "score", F.col("rank").cast("long").alias("rank"))


@query("named_source_boost", f"""WITH {ASKED},
a AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL),
n AS (SELECT source, {sql.tokens("regexp_replace(CASE WHEN source LIKE '%:%' THEN regexp_replace(source, '^[^:]*:', '') ELSE regexp_replace(source, '^#+', '') END, '([^.])\\.[^.]*$', '" + chr(92) + "1')")} AS t FROM a),
w AS (SELECT source, unnest(list_distinct({sql.content('t')})) AS word FROM n),
c AS (SELECT word, ln((SELECT count(*) FROM a) / count(*)) AS bonus FROM w GROUP BY word HAVING count(*) < (SELECT count(*) FROM a)),
qt AS (SELECT query_id, {sql.tokens('query')} AS t FROM q), qw AS (SELECT query_id, unnest(list_distinct({sql.content('t')})) AS word FROM qt)
SELECT query_id, source, round(1 + sum(bonus), 6) AS score FROM qw JOIN w USING (word) JOIN c USING (word) GROUP BY 1, 2""")
def named_source_boost(s, d):
    sources = table(s, d, "documents").select("source").filter("source is not null").distinct()
    q = asked(s, d)
    named = retrieve.name_boost(q.select("query_id").crossJoin(F.broadcast(sources)).withColumn("score", F.lit(1.0)), q, sources)
    return named.filter("score > 1").select("query_id", "source", "score")


@query("where_census", "WITH" + sql.STORE + f", h AS (SELECT source, sid FROM post WHERE {sql.stem('word', chr(39) + 'keeper' + chr(39))} INTERSECT SELECT source, sid FROM post WHERE {sql.stem('word', chr(39) + 'figures' + chr(39))}) SELECT source, count(*) AS lines FROM h GROUP BY source")
def where_census(s, d):
    return retrieve.where(lines(s, d), "keeper figures")


WORDS = ["boat", "weekdays", "valve", "flame", "crates"]


@query("census_pair", "WITH" + sql.STORE + f", h AS (SELECT * FROM post WHERE word IN {tuple(WORDS)}), p AS (SELECT a.word, b.word AS other, count(DISTINCT a.source) AS sources, count(*) AS lines FROM h a JOIN h b ON a.sid = b.sid AND a.word < b.word GROUP BY 1, 2) SELECT * FROM p ORDER BY sources DESC, lines, word, other LIMIT 1")
def census_pair(s, d):
    return retrieve.census_pair(store.postings(lines(s, d)), WORDS)


@query("supersede_latest", "WITH e AS (SELECT event_id, event_type AS family, CAST(user_id AS VARCHAR) AS name, ts, value FROM events) SELECT event_id, family, name, value FROM (SELECT *, rank() OVER (PARTITION BY family, name ORDER BY year(ts) DESC, month(ts) DESC, day(ts) DESC) AS r FROM e) WHERE r = 1")
def supersede_latest(s, d):
    e = table(s, d, "events").select("event_id", F.col("event_type").alias("family"), F.col("user_id").cast("string").alias("name"), F.array(F.year("ts"), F.month("ts"), F.dayofmonth("ts")).alias("stamp"), "value")
    return retrieve.superseded(e).select("event_id", "family", "name", "value")


@query("recency_vote", "WITH e AS (SELECT user_id AS query_id, event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) SELECT query_id, event_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY day DESC, rank) AS recent FROM e")
def recency_vote(s, d):
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    e = table(s, d, "events").withColumn("rank", F.row_number().over(by).cast("long")).select(F.col("user_id").alias("query_id"), "event_id", F.to_date("ts").alias("day"), "rank")
    return retrieve.recency(e).select("query_id", "event_id", "rank", F.col("recent").cast("long").alias("recent"))


@query("rrf_fuse", """
WITH a AS (SELECT source AS query_id, doc_id AS key, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents WHERE source IS NOT NULL),
b AS (SELECT source AS query_id, doc_id AS key, row_number() OVER (PARTITION BY source ORDER BY stamped_at DESC NULLS LAST, doc_id) AS rank FROM documents WHERE source IS NOT NULL),
f AS (SELECT query_id, key, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT query_id, key, score FROM f""")
def rrf_fuse(s, d):
    from pyspark.sql import Window

    docs = table(s, d, "documents").filter("source is not null").select("doc_id", "source", "n_chars", "stamped_at")
    rank = lambda c: F.row_number().over(Window.partitionBy("source").orderBy(F.col(c).desc_nulls_last(), "doc_id"))
    both = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("key"), rank("n_chars").alias("rank")).union(
        docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("key"), rank("stamped_at").alias("rank")))
    return retrieve.rrf_by(both).select("query_id", "key", "score")


@query("dense_near", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS cosine FROM q, v)
SELECT query_id, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS n FROM c) WHERE n <= 5""")
def dense_near(s, d):
    v = table(s, d, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieve.near(v, q).select("query_id", "vec_id", "cosine")


@query("unseen_demands", "WITH" + sql.STORE + f""", {ASKED}, qt AS (SELECT query_id, {sql.tokens('query')} AS t FROM q), qw AS (SELECT query_id, unnest(list_distinct({sql.content('t')})) AS word FROM qt),
voc AS (SELECT DISTINCT word AS term FROM post), kn AS (SELECT DISTINCT word FROM (SELECT DISTINCT word FROM qw) x JOIN voc ON left(word, 5) = left(term, 5) AND {sql.stem('word', 'term')})
SELECT query_id, word FROM qw WHERE word NOT IN (SELECT word FROM kn)""")
def unseen_demands(s, d):
    return answers.unseen_demands(asked(s, d), store.postings(lines(s, d)))


@query("source_profiles", "WITH" + sql.sentences() + r""", p AS (SELECT source, sentence, row_number() OVER (PARTITION BY source ORDER BY length(sentence) DESC, doc_id || ':' || pos) AS r FROM s),
g AS (SELECT source, string_agg(sentence, ' ' ORDER BY r) AS p FROM p WHERE r <= 12 GROUP BY source),
n AS (SELECT source, p, CASE WHEN source LIKE '%:%' THEN regexp_replace(source, '^[^:]*:', '') ELSE regexp_replace(source, '^#+', '') END AS nm FROM g)
SELECT source, left(concat_ws(' ', regexp_replace(nm, '([^.])\.[^.]*$', '\1'), p), 1200) AS profile FROM n""")
def source_profiles(s, d):
    return answers.profiles(lines(s, d))


@query("seats_topk")
def seats_topk(s, d):
    return scan.seated(checkpointed(lines(s, d)), asked(s, d))[0].select("query_id", "seat", "sid")


@query("find_full")
def find_full(s, d):
    return retrieve.find(checkpointed(lines(s, d)), asked(s, d)).select("query_id", "rank", "sid", "source", "score")


# ---- checks -----------------------------------------------------------------------------------------------------------


def pairs(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "gate_blame").select("pair_id", "question", "gold", "said").distinct()
    for c in ("question", "gold", "said"):
        p = tx.composed(p.withColumn(c, F.coalesce(c, F.lit(""))), c)
    return p


_PAIRS = f"""WITH p AS (SELECT DISTINCT pair_id, coalesce(question, '') AS question, coalesce(gold, '') AS gold, coalesce(said, '') AS said FROM gate_blame),
k AS (SELECT pair_id, {sql.tokens('said')} AS a, {sql.tokens('gold')} AS b, {sql.tokens('question')} AS c FROM p),
w AS (SELECT pair_id, a AS an, b AS bn, list_distinct({sql.content('a')}) AS aw, list_distinct({sql.content('b')}) AS ew, list_distinct({sql.content('c')}) AS qw FROM k)
"""


def _held(word: str, given: str) -> str:
    return f"len(list_filter({given}, lambda h: {sql.stem('h', word)})) > 0"


@query("check_figures_present", _PAIRS + f"SELECT pair_id, len(list_filter(an, lambda x: {sql.number('x')} AND NOT list_contains(bn, x))) = 0 AS figures_present FROM w")
def check_figures_present(s, d):
    return check.check(pairs(s, d), "said", "gold", "question").select("pair_id", "figures_present")


@query("demands_missing", _PAIRS + f"SELECT pair_id, CASE WHEN len(qw) > 0 THEN round(len(list_filter(qw, lambda q: {_held('q', 'aw')})) / len(qw), 6) ELSE 1.0 END AS carried, array_to_string(list_sort(list_filter(qw, lambda q: NOT {_held('q', 'aw')})), ' ') AS missing FROM w")
def demands_missing(s, d):
    return check.check(pairs(s, d), "said", "gold", "question").select("pair_id", F.round("carried", 6).alias("carried"), F.array_join(F.array_sort("missing"), " ").alias("missing"))


@query("unsupported_words", _PAIRS + f"SELECT pair_id, array_to_string(list_sort(list_filter(aw, lambda q: NOT {_held('q', 'ew')})), ' ') AS unsupported FROM w")
def unsupported_words(s, d):
    return check.check(pairs(s, d), "said", "gold", "question").select("pair_id", F.array_join(F.array_sort("unsupported"), " ").alias("unsupported"))


@query("check_answers")
def check_answers(s, d):
    return check.check(pairs(s, d), "said", "gold", "question").select("pair_id", "ok", "figures_ok", F.round("coverage", 6).alias("coverage"), F.round("carried", 6).alias("carried"))


@query("grounded_sentences")
def grounded_sentences(s, d):
    return check.grounded_sentences(pairs(s, d), "pair_id", "said", "gold")


# ---- records ------------------------------------------------------------------------------------------------------------


def cells(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part").select(F.concat(F.lit("part "), F.col("p_partkey")).alias("entity"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    customer = table(s, d, "customer").select(F.col("c_name").alias("entity"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return records.unpivoted(part, "entity").unionByName(records.unpivoted(customer, "entity"))


@query("unpivot_records", """
SELECT 'part ' || p_partkey AS entity, 'name' AS field, trim(p_name) AS value FROM part WHERE trim(p_name) <> '' UNION ALL SELECT 'part ' || p_partkey, 'brand', trim(p_brand) FROM part WHERE trim(p_brand) <> ''
UNION ALL SELECT 'part ' || p_partkey, 'kind', trim(p_type) FROM part WHERE trim(p_type) <> '' UNION ALL SELECT 'part ' || p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size IS NOT NULL
UNION ALL SELECT c_name, 'segment', trim(c_mktsegment) FROM customer WHERE trim(c_mktsegment) <> '' UNION ALL SELECT c_name, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey IS NOT NULL""")
def unpivot_records(s, d):
    return cells(s, d)


@query("label_resolve", f"""
WITH l AS (SELECT identity_key AS key, coalesce(seen, 0) AS seen, unnest(labels) AS label FROM (SELECT DISTINCT * FROM identities)),
f AS (SELECT {sql.fold('label')} AS folded, key, row_number() OVER (PARTITION BY {sql.fold('label')} ORDER BY seen DESC, key) AS n FROM l WHERE label IS NOT NULL),
b AS (SELECT folded, key FROM f WHERE n = 1), a AS (SELECT DISTINCT label || 'lar' AS name FROM l WHERE label IS NOT NULL UNION SELECT DISTINCT label FROM l WHERE label IS NOT NULL),
c AS (SELECT name, cut, left({sql.fold('name')}, greatest(length(name) - cut, 0)) AS folded FROM a, (SELECT unnest([0, 1, 2, 3]) AS cut)),
m AS (SELECT name, key, row_number() OVER (PARTITION BY name ORDER BY cut, key) AS n FROM c JOIN b USING (folded) WHERE cut = 0 OR length(folded) >= 5)
SELECT a.name, m.key FROM a LEFT JOIN m ON a.name = m.name AND m.n = 1""")
def label_resolve(s, d):
    l = table(s, d, "identities").distinct().select(F.col("identity_key").alias("key"), "seen", F.explode("labels").alias("label")).filter("label is not null")
    names = l.select(F.concat("label", F.lit("lar")).alias("name")).union(l.select("label")).distinct()
    return records.resolved(names, l)


@query("admit_witness_trust", "WITH" + sql.RECORDS + """
SELECT subject, predicate, value, count(DISTINCT source) AS witnesses, max(level) AS level,
  round(least(0.98, 1 - (1 - CASE max(level) WHEN 5 THEN 0.75 WHEN 4 THEN 0.6 WHEN 3 THEN 0.5 WHEN 2 THEN 0.35 ELSE 0.3 END) * pow(0.85, count(DISTINCT source) - 1)), 9) AS trust
FROM r WHERE source IS NOT NULL GROUP BY 1, 2, 3""")
def admit_witness_trust(s, d):
    return records.admitted(graph(s, d)).drop("at")


@query("arbitrate_slots", "WITH" + sql.RECORDS + """,
k AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY level DESC NULLS LAST, witnesses DESC NULLS LAST, told DESC NULLS LAST, trust DESC NULLS LAST, record_key) AS p,
  min(value) OVER (PARTITION BY subject, predicate) <> max(value) OVER (PARTITION BY subject, predicate) AS rivalled FROM g),
w AS (SELECT subject, predicate, value AS won, trust AS top FROM k WHERE p = 1)
SELECT record_key, rivalled AND value <> won AS lost, round(CASE WHEN rivalled AND value <> won THEN least(trust, least(top, 0.4) * 0.5) ELSE trust END, 9) AS new_trust FROM k JOIN w USING (subject, predicate)""")
def arbitrate_slots(s, d):
    return records.arbitrated(sound(s, d)).select("record_key", "lost", "new_trust")


@query("rival_measures", r"WITH" + sql.RECORDS + r""",
m AS (SELECT DISTINCT subject, predicate, CAST(regexp_extract(value, '^(\d+) (\S{1,4})', 1) AS DOUBLE) AS low, regexp_extract(value, '^(\d+) (\S{1,4})', 2) AS unit FROM r WHERE regexp_matches(value, '^\d+ \S{1,4}'))
SELECT a.subject, a.predicate, a.unit, a.low AS low_a, b.low AS low_b, a.low = b.low AS overlaps FROM m a JOIN m b ON a.subject = b.subject AND a.predicate = b.predicate AND a.unit = b.unit AND a.low < b.low""")
def rival_measures(s, d):
    m = graph(s, d).withColumn("m", tx.measure(F.col("value"))).filter(F.col("value").rlike(r"^\d+ \S{1,4}")).select("subject", "predicate", "m.low", "m.high", "m.unit")
    return records.rival_measures(m).select("subject", "predicate", "unit", "low_a", "low_b", "overlaps")


@query("pressure_tension", "WITH" + sql.RECORDS + """,
v AS (SELECT subject, predicate, value, max(trust) AS trust FROM g GROUP BY 1, 2, 3)
SELECT subject, predicate, value, round(least(trust, rival), 6) AS pressure FROM (SELECT *, max(trust) OVER (PARTITION BY subject, predicate ORDER BY trust, value ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS rival FROM v) WHERE rival IS NOT NULL""")
def pressure_tension(s, d):
    return records.pressure(sound(s, d))


@query("settle_fade_sleep", "WITH" + sql.RECORDS + """,
x AS (SELECT *, episodic AND coalesce(witnesses, 1) >= 2 AS settles, episodic AND coalesce(witnesses, 1) <= 1 AND coalesce(level, 1) < 5 AND epoch(TIMESTAMP '2026-12-01') - epoch(last_seen) >= 3600 AS fades FROM g)
SELECT record_key, round(CASE WHEN settles THEN greatest(trust, 0.65) WHEN fades THEN greatest(trust - 0.03, 0.1) ELSE trust END, 9) AS new_trust, episodic AND NOT settles AS now_episodic FROM x""")
def settle_fade_sleep(s, d):
    rows = sound(s, d).withColumn("witnesses", F.coalesce("witnesses", F.lit(1)))
    return records.slept(rows, F.lit(NOW)).select("record_key", "new_trust", "now_episodic")


@query("experience_prune", "SELECT event_id AS experience_key, round(abs(value) + abs(user_id % 7) / 10.0, 6) AS strength FROM events ORDER BY strength DESC, ts DESC, event_id LIMIT 2000")
def experience_prune(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("experience_key"), F.col("value").alias("outcome"), (F.abs(F.col("user_id") % 7) / 10.0).alias("surprise"), F.col("ts").alias("at"))
    return records.pruned_experiences(e).select("experience_key", "strength")


@query("gaps", "WITH" + sql.RECORDS + """, i AS (SELECT DISTINCT identity_key, seen FROM identities), h AS (SELECT subject AS identity_key, min(CAST(episodic AS INT)) AS e FROM r GROUP BY 1)
SELECT identity_key, CAST(CASE WHEN e IS NULL THEN 1.0 + coalesce(seen, 0) ELSE 0.5 + coalesce(seen, 0) END AS DOUBLE) AS gap FROM i LEFT JOIN h USING (identity_key) WHERE e IS NULL OR e = 1""")
def gaps(s, d):
    return records.gaps(table(s, d, "identities").select("identity_key", "seen").distinct(), graph(s, d))


@query("wonder", "WITH" + sql.RECORDS + """ SELECT identity_key, n AS "references" FROM (SELECT DISTINCT identity_key FROM identities) JOIN (SELECT predicate AS identity_key, count(*) AS n FROM r GROUP BY 1) USING (identity_key)
WHERE identity_key NOT IN (SELECT subject FROM g WHERE trust >= 0.4)""")
def wonder(s, d):
    rows = graph(s, d)
    rows = rows.withColumn("trust", F.when(F.col("trust").between(0, 1) & ~F.isnan("trust"), F.col("trust")))
    return records.wonder(table(s, d, "identities").select("identity_key").distinct(), rows)


def places(s: SparkSession, d: str) -> DataFrame:
    """Edges of the place hierarchy: customer and supplier in a nation, nation in a region, region in the world."""
    edge = lambda df, a, b: df.select(F.lit("in").alias("predicate"), a.alias("subject"), b.alias("value"))
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        edge(table(s, d, "customer"), n("c", "c_custkey"), n("n", "c_nationkey")).union(edge(table(s, d, "supplier"), n("s", "s_suppkey"), n("n", "s_nationkey")))
        .union(edge(table(s, d, "nation"), n("n", "n_nationkey"), n("r", "n_regionkey"))).union(edge(table(s, d, "region"), n("r", "r_regionkey"), F.lit("world")))
    )


_PLACES = """e AS (SELECT 'c' || c_custkey AS subject, 'n' || c_nationkey AS value FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region)"""


@query("transitive_triangles", f"WITH {_PLACES}, f AS (SELECT * FROM e UNION SELECT a.subject, b.value FROM e a JOIN e b ON a.value = b.subject WHERE a.subject LIKE 's%') SELECT 'in' AS predicate, count(*) AS closed FROM f a JOIN f b ON a.value = b.subject JOIN f c ON c.subject = a.subject AND c.value = b.value")
def transitive_triangles(s, d):
    e = places(s, d)
    two = e.alias("a").join(e.select(F.col("subject").alias("mid"), F.col("value").alias("far")), F.col("value") == F.col("mid")).filter("subject like 's%'").select("predicate", "subject", F.col("far").alias("value"))
    return records.triangles(e.union(two))


@query("derive_closure", f"WITH RECURSIVE {_PLACES}, c AS (SELECT subject, value, 1 AS hops FROM e UNION ALL SELECT c.subject, e.value, c.hops + 1 FROM c JOIN e ON c.value = e.subject WHERE c.hops < 8) SELECT 'in' AS predicate, subject, value, min(hops) AS hops FROM c GROUP BY 2, 3")
def derive_closure(s, d):
    return records.closure(places(s, d))


_FOLLOW = "f AS (SELECT DISTINCT event_type || (k % 5) AS cause, nt || ((k + 1) % 5) AS effect FROM (SELECT event_type, user_id % 5 AS k, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events) WHERE nt IS NOT NULL)"


@query("root_causes", f"""WITH {_FOLLOW}, n1 AS (SELECT 'purchase0' AS effect), e1 AS (SELECT DISTINCT f.effect, f.cause FROM f JOIN n1 USING (effect)),
n2 AS (SELECT DISTINCT cause AS effect FROM e1 EXCEPT SELECT effect FROM n1), e2 AS (SELECT DISTINCT f.effect, f.cause FROM f JOIN n2 USING (effect)),
n3 AS (SELECT DISTINCT cause AS effect FROM e2 EXCEPT (SELECT effect FROM n1 UNION SELECT effect FROM n2)), e3 AS (SELECT DISTINCT f.effect, f.cause FROM f JOIN n3 USING (effect)),
n4 AS (SELECT DISTINCT cause AS effect FROM e3 EXCEPT (SELECT effect FROM n1 UNION SELECT effect FROM n2 UNION SELECT effect FROM n3)), e4 AS (SELECT DISTINCT f.effect, f.cause FROM f JOIN n4 USING (effect))
SELECT 'purchase0' AS target, effect, cause, depth FROM (SELECT *, 1 AS depth FROM e1 UNION ALL SELECT *, 2 FROM e2 UNION ALL SELECT *, 3 FROM e3 UNION ALL SELECT *, 4 FROM e4)""")
def root_causes(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events").withColumn("nt", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("nt is not null")
    k = F.col("user_id") % 5
    causes = e.select(F.concat("event_type", (k % 5).cast("string")).alias("cause"), F.concat("nt", ((k + 1) % 5).cast("string")).alias("effect")).distinct()
    return records.root_causes(causes, s.createDataFrame([("purchase0",)], "target string")).select("target", "effect", "cause", "depth")


@query("gathered_top", "WITH" + sql.RECORDS + " SELECT subject, record_key, place FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY trust DESC, record_key) AS place FROM g WHERE trust >= 0.4) WHERE place <= 4")
def gathered_top(s, d):
    return records.gathered(sound(s, d)).select("subject", "record_key", F.col("place").cast("long").alias("place"))


@query("graph_lookup_answer", "SELECT c_custkey AS question_id, c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def graph_lookup_answer(s, d):
    c = cells(s, d)
    q = table(s, d, "customer").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("Which segment has "), F.col("c_name"), F.lit("?")).alias("question"))
    return records.lookup(c, c.select("entity").distinct(), q)


@query("memory_status", "WITH" + sql.RECORDS + " SELECT count(*) AS facts, 0 AS derived, round(sum(trust), 4) AS trust, (SELECT count(DISTINCT identity_key) FROM identities) AS concepts FROM g")
def memory_status(s, d):
    return records.status(sound(s, d), table(s, d, "identities").select("identity_key").distinct()).select("facts", F.coalesce("derived", F.lit(0)).cast("int").alias("derived"), "trust", "concepts")


@query("extremes_row", r"WITH" + sql.RECORDS + r""",
m AS (SELECT predicate AS head, source, CAST(regexp_extract(value, '^(\d+) (\S{1,4})', 1) AS DOUBLE) AS low, regexp_extract(value, '^(\d+) (\S{1,4})', 2) AS unit FROM r WHERE regexp_matches(value, '^\d+ \S{1,4}') AND source IS NOT NULL),
h AS (SELECT head FROM m GROUP BY 1 HAVING count(DISTINCT source) >= 3), u AS (SELECT head, unit, count(*) AS n, row_number() OVER (PARTITION BY head ORDER BY count(*) DESC, unit) AS p FROM m GROUP BY 1, 2),
b AS (SELECT m.*, row_number() OVER (PARTITION BY m.head ORDER BY low DESC, source DESC) AS hi, row_number() OVER (PARTITION BY m.head ORDER BY low, source) AS lo FROM m JOIN u ON m.head = u.head AND m.unit = u.unit AND u.p = 1 AND u.n >= 3 WHERE m.head IN (SELECT head FROM h))
SELECT x.head, x.unit, x.low AS high, x.source AS high_source, y.low, y.source AS low_source FROM (SELECT * FROM b WHERE hi = 1) x JOIN (SELECT * FROM b WHERE lo = 1) y ON x.head = y.head WHERE x.low <> y.low""")
def extremes_row(s, d):
    m = graph(s, d).filter(F.col("value").rlike(r"^\d+ \S{1,4}") & F.col("source").isNotNull()).withColumn("m", tx.measure(F.col("value")))
    return records.extremes(m.select(F.col("predicate").alias("head"), "source", "m.low", "m.unit"))


@query("comparison_row", r"WITH" + sql.RECORDS + r""",
v AS (SELECT subject || '/' || predicate AS head, source, list_sort(list_distinct(list(value))) AS vals FROM r WHERE source IN ('operator', 'reader-2') GROUP BY 1, 2),
x AS (SELECT a.head, a.vals AS a, b.vals AS b, list_sort(list_distinct(flatten(list_transform(a.vals, lambda z: regexp_extract_all(z, '\d+'))))) AS da, list_sort(list_distinct(flatten(list_transform(b.vals, lambda z: regexp_extract_all(z, '\d+'))))) AS db
  FROM v a JOIN v b ON a.head = b.head AND a.source = 'operator' AND b.source = 'reader-2')
SELECT head, CASE WHEN len(da) > 0 AND da = db THEN ' = ' WHEN len(da) > 0 AND len(db) > 0 THEN ' ≠ ' ELSE ' · ' END AS sign, array_to_string(a, '; ') AS first_values, array_to_string(b, '; ') AS second_values FROM x""")
def comparison_row(s, d):
    v = graph(s, d).select(F.concat_ws("/", F.col("subject").cast("string"), F.col("predicate").cast("string")).alias("head"), "source", "value")
    return records.compared(v, "operator", "reader-2")


# ---- entity graph ---------------------------------------------------------------------------------------------------------


def unique_lines(s: SparkSession, d: str) -> DataFrame:
    return entities.line_tokens(store.with_sid(store.deduplicated(sentences(s, d))))


_GRAMS = "WITH" + sql.sentences() + f""",
dd AS (SELECT doc_id, pos, source, sentence, row_number() OVER (PARTITION BY {sql.fold('sentence')}, source ORDER BY doc_id, pos) AS n FROM s),
tk AS (SELECT doc_id || ':' || pos AS sid, source, {sql.tokens('sentence')} AS t FROM dd WHERE n = 1), li AS (SELECT sid, source, {sql.content('t')} AS toks FROM tk),
sz AS (SELECT toks, unnest([1, 2, 3, 4, 5, 6]) AS size FROM li), st AS (SELECT toks, size, unnest(range(1, len(toks) - size + 2)) AS i FROM sz WHERE len(toks) >= size),
c AS (SELECT array_to_string(list_slice(toks, i, i + size - 1), ' ') AS gram, size, count(*) AS n FROM st GROUP BY 1, 2 HAVING count(*) >= 2),
tot AS (SELECT sum(len(toks)) AS total FROM li), cw AS (SELECT *, string_split(gram, ' ') AS w FROM c),
sp AS (SELECT gram, size, n, w, unnest(range(1, size)) AS cut FROM cw WHERE size BETWEEN 2 AND 5 AND n >= 3),
sd AS (SELECT gram, size, n, array_to_string(list_slice(w, 1, cut), ' ') AS l, array_to_string(list_slice(w, cut + 1, size), ' ') AS r FROM sp),
co AS (SELECT sd.gram, sd.size, sd.n, round(min(ln(sd.n * CAST(tot.total AS DOUBLE) / (a.n * b.n))), 6) AS cohesion, min(greatest(sd.n / a.n, sd.n / b.n)) AS share FROM sd JOIN c a ON a.gram = sd.l JOIN c b ON b.gram = sd.r, tot GROUP BY 1, 2, 3),
lg AS (SELECT array_to_string(list_slice(w, 1, size - 1), ' ') AS gram, n AS beside FROM cw WHERE size > 2 UNION ALL SELECT array_to_string(list_slice(w, 2, size), ' '), n FROM cw WHERE size > 2),
cr AS (SELECT gram, max(beside) AS beside FROM lg GROUP BY 1),
fr AS (SELECT co.* FROM co LEFT JOIN cr USING (gram) WHERE cohesion >= 1.0 AND share > 0.5 AND 2 * coalesce(beside, 0) <= n),
ik AS (SELECT string_split(gram, ' ') AS w, size, unnest(range(2, size)) AS k FROM fr WHERE size > 2), ii AS (SELECT w, k, unnest(range(1, size - k + 2)) AS i FROM ik),
ir AS (SELECT DISTINCT array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM ii),
ph AS (SELECT gram, size, n, cohesion FROM fr WHERE gram NOT IN (SELECT gram FROM ir))"""


@query("collocations_pmi", _GRAMS + " SELECT gram, size, n, cohesion FROM ph")
def collocations_pmi(s, d):
    return entities.collocations(unique_lines(s, d))


def entity_edges(s: SparkSession, d: str) -> DataFrame:
    rows = checkpointed(unique_lines(s, d))
    names = entities.collocations(rows).select(F.col("gram").alias("entity"))
    return entities.edges(entities.mentions(rows, names), rows.agg(F.count(F.lit(1)).alias("total")))


@query("entity_edges_g2", _GRAMS + """,
mt AS (SELECT DISTINCT sid, array_to_string(list_slice(toks, i, i + size - 1), ' ') AS entity FROM (SELECT sid, toks, size, unnest(range(1, len(toks) - size + 2)) AS i FROM (SELECT sid, toks, unnest([2, 3, 4, 5]) AS size FROM li) WHERE len(toks) >= size)),
me AS (SELECT sid, entity FROM mt WHERE entity IN (SELECT gram FROM ph)), ct AS (SELECT entity, count(*) AS n FROM me GROUP BY 1),
pr AS (SELECT a.entity AS a, b.entity AS b, count(*) AS k11 FROM me a JOIN me b ON a.sid = b.sid AND a.entity < b.entity GROUP BY 1, 2),
kk AS (SELECT a, b, CAST(k11 AS DOUBLE) AS k11, CAST(x.n - k11 AS DOUBLE) AS k12, CAST(y.n - k11 AS DOUBLE) AS k21, CAST((SELECT count(*) FROM li) AS DOUBLE) AS total FROM pr JOIN ct x ON x.entity = a JOIN ct y ON y.entity = b),
k4 AS (SELECT *, greatest(total - k11 - k12 - k21, 0) AS k22 FROM kk)
SELECT a, b, CAST(k11 AS BIGINT) AS k11, round(2 * (k11 * ln(k11 / ((k11 + k12) * (k11 + k21) / total)) + CASE WHEN k12 > 0 AND (k11 + k12) * (k12 + k22) > 0 THEN k12 * ln(k12 / ((k11 + k12) * (k12 + k22) / total)) ELSE 0 END
 + CASE WHEN k21 > 0 AND (k21 + k22) * (k11 + k21) > 0 THEN k21 * ln(k21 / ((k21 + k22) * (k11 + k21) / total)) ELSE 0 END + CASE WHEN k22 > 0 AND (k21 + k22) * (k12 + k22) > 0 THEN k22 * ln(k22 / ((k21 + k22) * (k12 + k22) / total)) ELSE 0 END), 6) AS g2 FROM k4""")
def entity_edges_g2(s, d):
    return entity_edges(s, d)


def _ends(links: DataFrame) -> tuple[str, str]:
    top = links.orderBy(F.col("k11").desc(), "a", "b").limit(1).collect()
    return (top[0]["a"], top[0]["b"]) if top else ("", "")


@query("pagerank_entities")
def pagerank_entities(s, d):
    links = checkpointed(entity_edges(s, d))
    return entities.pagerank(links, s.createDataFrame([("pair", e) for e in _ends(links)], "walk string, entity string"))


@query("communities_themes")
def communities_themes(s, d):
    rows = checkpointed(unique_lines(s, d))
    found = checkpointed(entities.mentions(rows, entities.collocations(rows).select(F.col("gram").alias("entity"))))
    links = checkpointed(entities.edges(found, rows.agg(F.count(F.lit(1)).alias("total"))))
    return entities.communities(links, common=entities.everywhere(found, rows))


@query("bridge_entities")
def bridge_entities(s, d):
    links = checkpointed(entity_edges(s, d))
    return entities.bridges(links, *_ends(links))


# ---- plans --------------------------------------------------------------------------------------------------------------


@query("plan_anchor_latest", f"WITH {DATED} SELECT min(day) AS first_day, max(day) AS last_day FROM l WHERE event_type = 'purchase'")
def plan_anchor_latest(s, d):
    first = algebra.run("a = anchor: purchase", dated(s, d)).toDF("first_day")
    return first.crossJoin(algebra.run("a = latest: purchase", dated(s, d)).toDF("last_day"))


@query("plan_span", f"WITH {DATED} SELECT abs(date_diff('day', min(day) FILTER (event_type = 'signup'), max(day) FILTER (event_type = 'error'))) AS days FROM l")
def plan_span(s, d):
    return algebra.run("a = anchor: signup\nb = latest: error\nc = span: a, b", dated(s, d)).select(F.col("days").cast("long").alias("days"))


@query("plan_before", f"WITH {DATED} SELECT min(day) FILTER (event_type = 'signup') < max(day) FILTER (event_type = 'click') AS earlier FROM l")
def plan_before(s, d):
    return algebra.run("a = anchor: signup\nb = latest: click\nc = before: a, b", dated(s, d))


@query("plan_lines_filter_count", f"WITH {DATED} SELECT count(*) AS n FROM l WHERE event_type = 'view' AND day > (SELECT min(day) FROM l WHERE event_type = 'purchase')")
def plan_lines_filter_count(s, d):
    return algebra.run("l = lines: view\na = anchor: purchase\nf = after_lines: l, a\nc = count: f", dated(s, d))


@query("plan_month_tally", "SELECT strftime(o_orderdate, '%Y/%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, month LIMIT 1")
def plan_month_tally(s, d):
    return algebra.month_tally(table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")))


@query("plan_amounts", f"""WITH {DATED}, a AS (SELECT amount, sid FROM l WHERE event_type = 'purchase' AND amount IS NOT NULL ORDER BY day, sid LIMIT 1), b AS (SELECT amount, sid FROM l WHERE event_type = 'click' AND amount IS NOT NULL ORDER BY day, sid LIMIT 1)
SELECT round(a.amount - b.amount, 6) AS minus, CASE WHEN b.amount <> 0 THEN round(100 * (a.amount / b.amount), 6) END AS ratio FROM a, b""")
def plan_amounts(s, d):
    step = "a = amount: purchase\nb = amount: click\nc = {}: a, b"
    minus, ratio = (algebra.run(step.format(op), dated(s, d)).select(F.col("value").alias(op)) for op in ("minus", "ratio"))
    return minus.crossJoin(ratio)


@query("verified_sum", r"""WITH l AS (SELECT o_orderkey AS sid, 'order ' || o_orderkey || ' came to ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' crowns' AS sentence FROM orders), i AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS item, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS a FROM orders)
SELECT round(sum(CAST(a AS DOUBLE)), 2) AS total, CAST(CAST(sum(CAST(a AS DOUBLE)) AS BIGINT) AS VARCHAR) AS shown FROM i""")
def verified_sum(s, d):
    o = table(s, d, "orders").withColumn("a", F.floor("o_totalprice").cast("bigint").cast("string"))
    l = o.select(F.col("o_orderkey").alias("sid"), F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" came to "), F.col("a"), F.lit(" crowns")).alias("sentence"))
    return algebra.verified_sum(o.select(F.col("o_custkey").cast("string").alias("item"), F.col("a").alias("amount_text")), l)


# ---- streams --------------------------------------------------------------------------------------------------------------


@query("stream_event_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return learn.windowed(e, "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


# ---- general data problems -----------------------------------------------------------------------------------------------------


@query("p4_found")
def p4_found(s, d):
    nodes = label_trees(table(s, d, "gguf_factfirst"), "run_id")
    return nodes.filter(F.col("kind").isin("question", "bucket", "evidence")).select("run_id", "node_path")


for _name in ("runs", "arms", "questions", "buckets", "evidence"):
    QUERIES[f"p4_{_name}"] = lambda s, d, n=_name: run_tables(table(s, d, "gguf_factfirst"))[n]


@query("p5_found")
def p5_found(s, d):
    return schema_drift.changes(table(s, d, "bucket_files"))


@query("p5_table")
def p5_table(s, d):
    return schema_drift.consistent_table(table(s, d, "bucket_files"))


@query("p5_failed_casts")
def p5_failed_casts(s, d):
    return schema_drift.failed_casts(table(s, d, "bucket_files"))
