"""Queries of the gates, identities, write side and readers, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import answers, check, claims, entities, identity, records, retrieve, store
from cairn.queries import sql
from cairn.queries.core import _FIND, _PLACES, ASKED, ORACLE, _NAME, asked, dated, graph, lines, pairs, places, query, sentences, sound, unique_lines
from cairn.session import checkpointed, table
from cairn.sources import readers
from cairn.streaming import learn

# ---- text ---------------------------------------------------------------------------------------------------------

_PAIRS_OF = "WITH" + sql.sentences() + rf""",
sg AS (SELECT doc_id, source, pos, sentence, list_transform(string_split_regex(regexp_replace(sentence, '([.!?])[\s\x0B]+', '\1' || chr(10), 'g'), '\n'), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')) AS parts FROM s),
se AS (SELECT doc_id, source, pos, unnest(range(len(parts))) AS nth, unnest(parts) AS seg FROM sg),
hv AS (SELECT doc_id, source, pos, nth,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(seg, '(?s):.*$', ''), '(?s)^.*—', ''), '^[·•*\-– \t]+|[\s\x0B]+$', '', 'g'), '^(?:\d{{1,3}}\.[\s\x0B]*)+', ''), '^[\s\x0B]+', '') AS head,
  regexp_replace(regexp_replace(seg, '(?s)^[^:]*:', ''), '^[\s\x0B]+|[\s\x0B.]+$', '', 'g') AS value FROM se WHERE contains(seg, ':') AND length(seg) <= 200),
ht AS (SELECT *, {sql.tokens('head')} AS t FROM hv WHERE value <> ''), hw AS (SELECT *, {sql.content('t')} AS w FROM ht),
rp AS (SELECT * FROM hw WHERE len(w) BETWEEN 1 AND 3)
"""
ORACLE["record_pairs"] = _PAIRS_OF + "SELECT doc_id, pos, head, value FROM rp"
ORACLE["field_heads"] = _PAIRS_OF + f'SELECT {sql.fold("head")} AS head, count(DISTINCT source) AS sources, count(DISTINCT value) AS "values" FROM rp GROUP BY 1 HAVING count(DISTINCT source) >= 2'

_LINES_OF = r"""
a AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM a)"""
_ROWS_OF = "WITH" + _LINES_OF + r""",
m AS (SELECT *, length(line) - length(replace(line, '|', '')) AS bars, length(line) - length(replace(line, chr(9), '')) AS tabs FROM b),
c AS (SELECT doc_id, pos, list_transform(CASE WHEN bars >= 2 THEN string_split(regexp_replace(line, '^\s*\||\|\s*$', '', 'g'), '|') ELSE string_split(line, chr(9)) END, lambda x: trim(x, ' ')) AS cells FROM m WHERE bars >= 2 OR tabs >= 2),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run, len(cells) AS width FROM c),
w AS (SELECT doc_id, run, width, count(*) AS n, row_number() OVER (PARTITION BY doc_id, run ORDER BY count(*) DESC, width DESC) AS p FROM r GROUP BY 1, 2, 3),
t AS (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id, r.run ORDER BY pos) AS at FROM r JOIN w ON r.doc_id = w.doc_id AND r.run = w.run AND r.width = w.width AND w.p = 1 AND w.n >= 2),
f AS (SELECT *, len(list_filter(cells, lambda x: NOT regexp_matches(x, '^:?-{2,}:?$'))) = 0 AS rule FROM t)
"""
ORACLE["table_records"] = _ROWS_OF + """, h AS (SELECT a.doc_id, a.run, a.cells FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.run = b.run AND a.at = 1 AND b.at = 2 AND b.rule),
x AS (SELECT f.doc_id, f.pos, unnest(h.cells) AS name, unnest(f.cells) AS value FROM f JOIN h ON f.doc_id = h.doc_id AND f.run = h.run WHERE f.at > 2 AND NOT f.rule)
SELECT doc_id, pos, name, value FROM x WHERE name IS NOT NULL AND value <> ''"""
ORACLE["front_matter"] = "WITH" + _LINES_OF + r""",
d AS (SELECT doc_id, list_sort(list(length(line)))[count(*) // 2 + 1] AS median FROM b GROUP BY 1),
u AS (SELECT doc_id, pos, line, median, sum(length(line)) OVER w AS upto, max(CASE WHEN regexp_matches(line, '[.!?]$') THEN 1 ELSE 0 END) OVER w AS ended FROM b JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*) AS lines, string_agg(line, ' ' ORDER BY pos) AS masthead FROM u WHERE upto <= 12 * median AND ended = 0 GROUP BY 1 HAVING count(*) >= 2"""


def order_lines(s: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as an index: a text and an ordinal at its end."""
    o = table(s, d, "orders")
    at = F.row_number().over(_by_customer()) - 1
    return o.select(F.col("o_custkey").alias("doc_id"), at.alias("pos"), F.concat(F.lit("order of "), F.lower("o_orderpriority"), F.lit(" "), (F.col("o_orderkey") % 5000).cast("string")).alias("line"))


def _by_customer():
    from pyspark.sql import Window

    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


_ORDERS = r"""WITH b AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, 'order of ' || lower(o_orderpriority) || ' ' || (o_orderkey % 5000) AS line FROM orders),
c AS (SELECT doc_id, pos, line, CAST(nullif(regexp_extract(line, '\s(\d{1,5})\s*$', 1), '') AS INT) AS n FROM b),
e AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c),
f AS (SELECT *, sum(CASE WHEN n IS NULL OR before IS NULL OR n < before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM e),
g AS (SELECT doc_id, run, min(pos) AS start, count(*) AS lines FROM f WHERE n IS NOT NULL GROUP BY doc_id, run HAVING count(*) >= 3 AND min(n) < max(n))
"""


@query("index_columns_of_orders", _ORDERS + "SELECT doc_id, start, lines FROM g")
def index_columns_of_orders(s, d):
    return store.locator_runs(order_lines(s, d)).withColumn("start", F.col("start").cast("long"))


@query("locators_stripped", _ORDERS + r"SELECT f.doc_id, f.pos, CASE WHEN g.run IS NOT NULL AND n IS NOT NULL THEN regexp_replace(line, '\s+\d{1,5}\s*$', '') ELSE line END AS line FROM f LEFT JOIN g ON f.doc_id = g.doc_id AND f.run = g.run")
def locators_stripped(s, d):
    return store.without_locators(order_lines(s, d)).withColumn("pos", F.col("pos").cast("long"))


@query("measure_overlap", r"""
WITH m AS (SELECT DISTINCT l_orderkey AS slot, least(l_quantity, l_quantity + l_linenumber) AS low, greatest(l_quantity, l_quantity + l_linenumber) AS high FROM lineitem WHERE l_orderkey % 7 = 3 OR true)
SELECT a.slot, a.low AS low_a, b.low AS low_b, a.low <= b.high AND b.low <= a.high AS overlaps FROM m a JOIN m b ON a.slot = b.slot AND a.low < b.low GROUP BY ALL""".replace(" WHERE l_orderkey % 7 = 3 OR true", ""))
def measure_overlap(s, d):
    """Ranges '3.0 kg to 5.0 kg' read back from text, compared within an order."""
    l = table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber")
    said = F.concat(F.col("l_quantity").cast("string"), F.lit(" kg to "), (F.col("l_quantity") + F.col("l_linenumber")).cast("string"), F.lit(" kg"))
    m = l.select(F.col("l_orderkey").alias("subject"), F.lit("q").alias("predicate"), tx.measure(said).alias("m")).select("subject", "predicate", "m.low", "m.high", "m.unit")
    return records.rival_measures(m).select(F.col("subject").alias("slot"), "low_a", "low_b", "overlaps").distinct()


@query("reply_triples", """SELECT c_custkey, c_name AS subject, 'in' AS predicate, CAST(c_nationkey AS VARCHAR) AS value, false AS swallowed FROM customer UNION ALL
SELECT c_custkey, c_name || ' in ' || c_nationkey, 'is', CAST(c_nationkey AS VARCHAR), true FROM customer""")
def reply_triples(s, d):
    c = table(s, d, "customer").select("c_custkey", F.concat(
        F.lit('Here: {"triples": [["'), "c_name", F.lit('", "in", '), F.col("c_nationkey").cast("string"), F.lit('], {"subject": "'), "c_name", F.lit(" in "), F.col("c_nationkey").cast("string"),
        F.lit('", "relation": "is", "object": "'), F.col("c_nationkey").cast("string"), F.lit('"}, ["", "x", "y"]]} and {more}')).alias("reply"))
    each = c.select("c_custkey", F.explode(claims.reply_triples(F.col("reply"))).alias("t")).select("c_custkey", "t.*")
    return each.withColumn("swallowed", claims.malformed(F.col("subject"), F.col("value")))


@query("table_windows")
def table_windows(s, d):
    return store.table_windows(table(s, d, "documents"))


_CENSUS = _FIND + """, ch AS (SELECT DISTINCT query_id, root, sid, source FROM hits),
cp AS (SELECT a.query_id, a.root AS first_word, b.root AS second_word, count(DISTINCT a.source) AS sources, count(DISTINCT a.sid) AS lines FROM ch a JOIN ch b ON a.query_id = b.query_id AND a.sid = b.sid AND a.root < b.root GROUP BY 1, 2, 3),
cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sources DESC, lines, first_word, second_word) AS n FROM cp) WHERE n = 1)
"""


@query("census_of_questions", _CENSUS + 'SELECT query_id, first_word AS "first", second_word AS "second", sources, lines FROM cb')
def census_of_questions(s, d):
    return retrieve.census(asked(s, d), store.postings(lines(s, d)))[0]


@query("census_tally", _CENSUS + "SELECT cb.query_id, a.source, count(DISTINCT a.sid) AS lines FROM cb JOIN ch a ON a.query_id = cb.query_id AND a.root = first_word JOIN ch b ON b.query_id = cb.query_id AND b.root = second_word AND b.sid = a.sid GROUP BY 1, 2")
def census_tally(s, d):
    return retrieve.census(asked(s, d), store.postings(lines(s, d)))[1]


# ---- gates ----------------------------------------------------------------------------------------------------------


@query("claims_attested", f"""
WITH e AS (SELECT lower(c_name) AS a, lower(n_name) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT lower(n_name), lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT n_name AS subject, c_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION SELECT c_name, n_name || ' COAST' FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT subject, value FROM q JOIN e ON lower(subject) = a AND lower(value) = b OR lower(subject) = b AND lower(value) = a),
h AS (SELECT DISTINCT a, unnest(list_filter(string_split_regex(b, '\\s+'), lambda w: length(w) >= 3)) AS h FROM e),
w AS (SELECT DISTINCT subject, value, unnest(list_filter(string_split_regex(lower(value), '\\s+'), lambda w: length(w) >= 3)) AS w FROM q),
y AS (SELECT subject, value FROM w JOIN h ON lower(subject) = a AND {sql.stem('w', 'h')})
SELECT subject, value FROM x UNION SELECT subject, value FROM y""")
def claims_attested(s, d):
    n, r, c = table(s, d, "nation"), table(s, d, "region"), table(s, d, "customer")
    cn = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    two = lambda df, a, b: df.select(F.col(a).alias("subject") if isinstance(a, str) else a.alias("subject"), F.col(b).alias("value") if isinstance(b, str) else b.alias("value"))
    edges = two(cn, "c_name", "n_name").union(two(cn, "n_name", "r_name"))
    told = two(cn, "n_name", "c_name").union(two(cn, "c_name", "r_name")).union(two(cn, "c_name", F.concat("n_name", F.lit(" COAST"))))
    return claims.attested(told, edges)


@query("answers_verified", """SELECT c_custkey AS answer_id, 'Hello there. ' || c_name || ' is in ' || n_name || '.' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def answers_verified(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    edges = c.select(F.col("c_name").alias("subject"), F.col("n_name").alias("value"))
    three = F.array(F.lit("Hello there."), F.concat("c_name", F.lit(" is in "), "n_name", F.lit(".")), F.concat("c_name", F.lit(" owns Atlantis.")))
    said = c.select(F.col("c_custkey").alias("answer_id"), F.posexplode(three).alias("pos", "sentence"))
    told = c.select(F.col("c_custkey").alias("answer_id"), F.lit(1).alias("pos"), F.col("c_name").alias("subject"), F.col("n_name").alias("value")).union(
        c.select("c_custkey", F.lit(2), "c_name", F.lit("Atlantis")))
    return claims.verified(said, told, edges)


@query("quoted_gate")
def quoted_gate(s, d):
    p = pairs(s, d)
    return claims.quoted(p.select(F.col("pair_id").alias("answer_id"), "question", "said", F.array("gold", "question").alias("lines"), F.array(F.lit(0)).alias("held")))


@query("facts_asserted")
def facts_asserted(s, d):
    return claims.asserts_fact(pairs(s, d).select(F.col("pair_id").alias("answer_id"), F.col("said").alias("answer"), F.array("gold", "question").alias("proofs")))


@query("judge_shortcuts")
def judge_shortcuts(s, d):
    p = pairs(s, d)
    return p.select("pair_id", claims.shortcut(F.col("question"), F.col("said"), F.array("gold")).alias("verdict"))


@query("source_counts", f"""WITH n AS (SELECT DISTINCT source FROM (SELECT source FROM documents UNION SELECT source FROM dynamics) WHERE source IS NOT NULL), t AS (SELECT source, {sql.tokens(_NAME)} AS t FROM n),
w AS (SELECT source, unnest(list_distinct({sql.content('t')})) AS word FROM t), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 2 AND count(*) < (SELECT count(*) FROM n))
SELECT source AS query_id, max(n) AS n FROM w JOIN c USING (word) GROUP BY 1""")
def source_counts(s, d):
    """How many sources share a word of each source's name."""
    known = table(s, d, "documents").select("source").union(table(s, d, "dynamics").select("source")).filter("source is not null").distinct()
    return claims.source_count(known.select(F.col("source").alias("query_id"), tx.source_name(F.col("source")).alias("query")), known)


@query("item_tally", "WITH" + sql.STORE + f""",
i AS (SELECT DISTINCT identity_key % 50 AS query_id, label AS item FROM (SELECT identity_key, unnest(labels) AS label FROM identities) WHERE label IS NOT NULL),
it AS (SELECT query_id, item, {sql.tokens('item')} AS k FROM i), iw AS (SELECT query_id, item, list_sort(list_distinct({sql.content('k')})) AS iw FROM it),
ix AS (SELECT DISTINCT iw FROM iw WHERE len(iw) > 0), ie AS (SELECT iw, unnest(iw) AS wd FROM ix), vo AS (SELECT DISTINCT word FROM post), iv AS (SELECT DISTINCT wd FROM ie),
pr AS (SELECT wd, word FROM iv JOIN vo ON left(wd, 3) = left(word, 3) AND {sql.stem('wd', 'word')}),
me AS (SELECT iw, sid FROM ie JOIN pr USING (wd) JOIN post USING (word) GROUP BY iw, sid HAVING count(DISTINCT wd) = len(iw)),
ca AS (SELECT query_id, iw, min(item) AS item FROM iw WHERE iw IN (SELECT iw FROM me) GROUP BY 1, 2)
SELECT query_id, count(*) AS n, string_agg(item, '; ' ORDER BY item) AS items FROM ca GROUP BY 1 HAVING count(*) >= 2""")
def item_tally(s, d):
    i = table(s, d, "identities").select("identity_key", F.explode("labels").alias("item")).filter("item is not null")
    return claims.item_tally(i.select((F.col("identity_key") % 50).alias("query_id"), "item").distinct(), lines(s, d))


@query("record_rows", _PAIRS_OF + f""", st AS (SELECT *, doc_id || ':' || pos AS sid FROM rp), fd AS (SELECT w AS hw, count(DISTINCT source) >= 2 AS field FROM st GROUP BY 1),
q AS (SELECT DISTINCT source, 'Which pressure and price has the valve?' AS query FROM documents WHERE source IS NOT NULL), qt AS (SELECT source, {sql.tokens('query')} AS t FROM q), qq AS (SELECT source, {sql.content('t')} AS qw FROM qt),
fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, w, value ORDER BY sid, nth) AS k FROM st) WHERE k = 1),
me AS (SELECT fi.source, sid, nth, head, value, field, len(list_filter(w, lambda k: len(list_filter(qw, lambda g: {sql.stem('k', 'g')} OR {sql.stem('k', 'g', 3)})) > 0)) AS asked FROM fi JOIN fd ON fi.w = fd.hw JOIN qq ON fi.source = qq.source),
rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY field DESC, asked DESC, sid, nth) AS place FROM me)
SELECT source AS query_id, place, sid, head || ': ' || value || '.' AS "row" FROM rk WHERE place <= 4""")
def record_rows(s, d):
    q = table(s, d, "documents").select("source").filter("source is not null").distinct().select(F.col("source").alias("query_id"), "source", F.lit("Which pressure and price has the valve?").alias("query"))
    return claims.record_rows(lines(s, d), q).withColumn("place", F.col("place").cast("long"))


@query("load_bearing")
def load_bearing(s, d):
    p = pairs(s, d)
    proof = p.select(F.col("pair_id").alias("answer_id"), "said", F.posexplode(F.array("gold", "question")).alias("place", "line"))
    return claims.load_bearing(proof.withColumn("origin", F.when(F.col("place") == 0, "#doc:harbour_guide").otherwise("#web:tide_board")), table(s, d, "documents"))


@query("candidates_selected")
def candidates_selected(s, d):
    p = pairs(s, d)
    each = p.select(F.col("pair_id").alias("query_id"), "question", F.col("gold").alias("proof"), F.posexplode(F.array("said", "gold")).alias("place", "said"))
    return claims.selected(each.withColumn("passes", F.col("said") != ""))


@query("answered")
def answered(s, d):
    from cairn.queries.core import cells

    return claims.answered(checkpointed(lines(s, d)), asked(s, d), cells(s, d), proofs=False).select("query_id", "kind", "answer", "abstained")


# ---- identities and the write side --------------------------------------------------------------------------------------


@query("neighbours_of_places", f"WITH {_PLACES} SELECT value AS key, subject AS other, false AS outward FROM e WHERE value LIKE 'r%' UNION SELECT subject, value, true FROM e WHERE subject LIKE 'r%'")
def neighbours_of_places(s, d):
    keys = table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"))
    return identity.neighbours(places(s, d), keys).select("key", "other", "outward")


@query("contradiction_fields", "WITH" + sql.RECORDS + """
SELECT record_key, CASE WHEN min(value) OVER w <> max(value) OVER w THEN min(record_key) OVER w ELSE record_key END AS field FROM r WINDOW w AS (PARTITION BY subject, predicate)""")
def contradiction_fields(s, d):
    known = graph(s, d)
    return identity.contradiction_fields(known, identity.contradictions(known))


@query("learned_transitive", f"WITH {_PLACES}, f AS (SELECT * FROM e UNION SELECT a.subject, b.value FROM e a JOIN e b ON a.value = b.subject) SELECT 'in' AS predicate, count(*) AS closed FROM f a JOIN f b ON a.value = b.subject JOIN f c ON c.subject = a.subject AND c.value = b.value HAVING count(*) >= 2")
def learned_transitive(s, d):
    e = places(s, d)
    two = e.join(e.select(F.col("subject").alias("mid"), F.col("value").alias("far")), F.col("value") == F.col("mid")).select("predicate", "subject", F.col("far").alias("value"))
    derived = two.withColumn("source", F.lit("#inference")).limit(0)
    told = e.union(two).distinct().withColumn("source", F.lit("#doc:places"))
    return identity.learned_transitive(told.unionByName(derived))


@query("cells_learned", """SELECT count(*) AS claims, count(DISTINCT subject) AS subjects, count(DISTINCT value) AS "values" FROM (SELECT DISTINCT c_name AS subject, 'segment' AS predicate, c_mktsegment AS value FROM customer WHERE c_mktsegment <> '')""")
def cells_learned(s, d):
    c = table(s, d, "customer")
    cells = c.select(F.col("c_name").alias("subject"), F.lit("segment").alias("predicate"), F.col("c_mktsegment").alias("value"), F.lit("#table:customer").alias("source"), F.lit(None).cast("timestamp").alias("at"))
    labels = table(s, d, "identities").distinct().select(F.explode("labels").alias("label"), F.col("identity_key").alias("key"), "seen").filter("label is not null")
    told, _ = identity.cell_claims(cells.union(c.select("c_name", F.lit("is"), "c_name", F.lit("x"), F.lit(None).cast("timestamp"))), labels)
    return told.agg(F.count_distinct("subject", "predicate", "value").alias("claims"), F.count_distinct("subject").alias("subjects"), F.count_distinct("value").alias("values"))


@query("claims_readmitted", "WITH" + sql.RECORDS + """
SELECT subject, predicate, value, count(DISTINCT source) AS witnesses, max(level) AS level FROM r WHERE source IS NOT NULL GROUP BY 1, 2, 3""")
def claims_readmitted(s, d):
    """Every record told in two halves: what the first half knows gains the second's witnesses."""
    told = graph(s, d).filter("source is not null").select("record_key", "subject", "predicate", "value", "source", "level", "at")
    none = s.createDataFrame([], "subject long, predicate long, value string, sources array<string>, level int, trust double, at timestamp, last_seen timestamp, episodic boolean")
    first = identity.readmitted(none, told.filter("record_key % 2 = 0"))
    both = identity.readmitted(checkpointed(first), told.filter("record_key % 2 = 1"))
    return both.select("subject", "predicate", "value", F.col("witnesses").cast("long").alias("witnesses"), "level")


@query("kv_cells", """SELECT p_partkey, 'Brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'Kind of part', p_type FROM part UNION ALL SELECT p_partkey, 'Size', CAST(p_size AS VARCHAR) || ' mm' FROM part""")
def kv_cells(s, d):
    p = table(s, d, "part").select("p_partkey", F.array(F.concat(F.lit("Brand: "), "p_brand", F.lit(", Kind of part: "), "p_type")).alias("a"), F.array(F.concat(F.lit("Size "), F.col("p_size").cast("string"), F.lit(" mm"))).alias("b"))
    rows = p.select("p_partkey", F.lit(0).alias("pos"), F.col("a").alias("cells")).union(p.select("p_partkey", F.lit(1), "b"))
    return readers.table_claims(rows, "p_partkey").select("p_partkey", "key", "value")


@query("days_shown", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day, abs(date_diff('month', CAST(o_orderdate AS DATE), DATE '1998-01-31')) AS months, CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-31')) AS VARCHAR) || ' days (' || (abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-31')) + 1) || ' including the last day)' AS span FROM orders")
def days_shown(s, d):
    day, end = F.to_date("o_orderdate"), F.lit("1998-01-31").cast("date")
    return table(s, d, "orders").select("o_orderkey", answers.shown_day(day).alias("day"), answers.months_between(day, end).alias("months"), answers.shown_span(day, end).alias("span"))


@query("common_lines", "WITH" + sql.STORE + " SELECT sid FROM post WHERE word IN ('keeper', 'figures') GROUP BY sid HAVING count(DISTINCT word) = 2")
def common_lines(s, d):
    return answers.meeting_lines(store.postings(lines(s, d)).withColumnRenamed("word", "entity"), ["keeper", "figures"])


@query("heads_voted", "WITH b AS (SELECT DISTINCT event_type AS word, 'h' || (user_id % 20) AS head FROM events), n AS (SELECT word, ln(1 + (SELECT count(DISTINCT head) FROM b) / count(*)) AS w FROM b GROUP BY 1), v AS (SELECT head, round(sum(w), 6) AS vote FROM b JOIN n USING (word) WHERE word IN ('click', 'purchase') GROUP BY 1) SELECT 1 AS query_id, head, vote FROM v WHERE vote = (SELECT max(vote) FROM v)")
def heads_voted(s, d):
    b = table(s, d, "events").select(F.col("event_type").alias("word"), F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("head"))
    return answers.heads_by_vote(b, s.createDataFrame([(1, "click or purchase")], "query_id int, query string"))


@query("fields_spread", f"WITH {_PLACES}, b AS (SELECT subject AS src, value AS dst FROM e UNION SELECT value, subject FROM e), l1 AS (SELECT DISTINCT dst AS entity FROM b WHERE src = 'r0'), l2 AS (SELECT DISTINCT dst AS entity FROM b JOIN l1 ON src = entity), l3 AS (SELECT DISTINCT dst AS entity FROM b JOIN l2 ON src = entity), u AS (SELECT 'r0' AS entity, 1.0 AS w UNION ALL SELECT entity, 0.6 FROM l1 UNION ALL SELECT entity, 0.36 FROM l2 UNION ALL SELECT entity, 0.216 FROM l3) SELECT entity, round(max(CAST(w AS DOUBLE)), 6) AS weight FROM u GROUP BY 1 ORDER BY weight DESC, entity LIMIT 40")
def fields_spread(s, d):
    e = places(s, d)
    walk = e.select(F.col("subject").alias("src"), F.col("value").alias("dst")).union(e.select("value", "subject")).distinct()
    return entities.spread(walk, s.createDataFrame([("r0",)], "entity string"))


@query("suspects_judged", "WITH" + sql.RECORDS + """,
k AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY level DESC NULLS LAST, witnesses DESC NULLS LAST, trust DESC NULLS LAST, record_key) AS p FROM g),
a AS (SELECT subject, predicate, value AS anchor FROM k WHERE p = 1)
SELECT DISTINCT g.subject, g.predicate, anchor, value, length(anchor) <> length(value) AS rival FROM g JOIN a USING (subject, predicate) WHERE value <> anchor""")
def suspects_judged(s, d):
    return answers.judged_suspects(sound(s, d), lambda a, b: a.str.len() != b.str.len())


@query("claims_supported", "WITH" + sql.RECORDS + ", p AS (SELECT subject, value, max(witnesses) AS witnesses, max(level) AS level FROM g WHERE trust >= 0.4 GROUP BY 1, 2) SELECT DISTINCT r.record_key AS claim_id, p.level IS NOT NULL AS backed, p.level IS NOT NULL AND coalesce(p.witnesses, 1) <= 1 AND p.level <= 1 AS doubtful FROM r LEFT JOIN p USING (subject, value)")
def claims_supported(s, d):
    told = graph(s, d).select(F.col("record_key").alias("claim_id"), "subject", "value")
    return answers.supported(told, sound(s, d)).distinct()


@query("fields_admissible")
def fields_admissible(s, d):
    p = pairs(s, d)
    return p.select("pair_id", answers.substance_ok(F.col("said"), F.col("question"), F.lit("harbour guide"), F.col("gold")).alias("substance"),
                    answers.field_ok(F.col("said"), F.col("question"), F.lit("pressure"), F.col("gold")).alias("field"), answers.line_admissible(F.col("said"), F.col("gold")).alias("line"))


@query("self_clashes", r"WITH" + sql.RECORDS + r""", v AS (SELECT source, subject || '/' || predicate AS head, value, array_to_string(regexp_extract_all(value, '\d+'), ' ') AS d FROM r WHERE source IS NOT NULL)
SELECT source, head, string_agg(DISTINCT value, ' ≠ ' ORDER BY value) AS clash FROM v WHERE d <> '' GROUP BY 1, 2 HAVING count(DISTINCT d) > 1""")
def self_clashes(s, d):
    return records.self_clashes(graph(s, d).select("source", F.concat_ws("/", F.col("subject").cast("string"), F.col("predicate").cast("string")).alias("head"), "value"))


@query("records_associated", "WITH" + sql.RECORDS + """,
p AS (SELECT record_key, subject, CAST(CASE WHEN record_key % 3 = 0 THEN CAST(predicate AS VARCHAR) ELSE value END AS VARCHAR) AS value, trust FROM g WHERE trust >= 0.4),
h AS (SELECT subject, record_key, trust, 0 AS hop FROM p UNION ALL SELECT a.subject, b.record_key, b.trust, 1 FROM p a JOIN p b ON a.value = CAST(b.subject AS VARCHAR)),
m AS (SELECT subject, record_key, max(trust) AS trust, min(hop) AS hop FROM h GROUP BY 1, 2)
SELECT subject, record_key, hop, place FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY trust DESC, record_key) AS place FROM m) WHERE place <= 4""")
def records_associated(s, d):
    """A third of the values point at other subjects, so that there is a hop."""
    known = sound(s, d).withColumn("value", F.when(F.col("record_key") % 3 == 0, F.col("predicate").cast("string")).otherwise(F.col("value")))
    return records.associated(known, known).withColumn("place", F.col("place").cast("long"))


@query("experiences_recalled", "SELECT event_id AS experience_key, round(least(1.0, abs(value - 50)), 6) AS surprise FROM events WHERE user_id % 10 IN (3, 7) ORDER BY surprise DESC, ts DESC, event_id LIMIT 8")
def experiences_recalled(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("experience_key"), F.round(records.weighed(F.lit(50.0), F.col("value")), 6).alias("surprise"), F.col("ts").alias("at"), F.array(F.col("user_id") % 10).alias("about"))
    return records.recalled(e, [3, 7]).select("experience_key", "surprise")


@query("entities_named")
def entities_named(s, d):
    rows = checkpointed(unique_lines(s, d))
    return entities.named_in(rows, entities.collocations(rows).select(F.col("gram").alias("entity")))


# ---- streams --------------------------------------------------------------------------------------------------------------


@query("stream_sliding_windows", """WITH w AS (SELECT ts, event_type, unnest([0, 1, 2, 3]) AS k FROM events)
SELECT CAST(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '6 hours' AS TIMESTAMP) AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding_windows(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return learn.sliding(e, "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", """WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '12 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS cut, event_id FROM events),
b AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*) AS n FROM b GROUP BY user_id, run""")
def stream_sessions(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return learn.sessions(e, "ts", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
