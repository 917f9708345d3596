"""Ranked retrieval over the sentence store (AG-02 .. AG-05, RK-01 .. RK-12, JN-02, JN-04, JN-09)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.session import checkpointed

RRF, CHANNEL = 60, 2
#: A query's rarest groups are scored first until they make up so many lines; a bound from more lines is tighter, never another result.
FIRST_LINES = 64


def query_words(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """JN-02: (query_id, word, term): vocabulary words of the stem or kin of each query word.

    The theta join is an equi-join on the first three letters with the exact test behind it, on distinct
    words of either side only.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.words(F.col("query")))).alias("word"))
    words = asked.select("word").distinct().withColumn("head", F.left("word", F.lit(3)))
    known = vocabulary.select(F.col("word").alias("term")).distinct().withColumn("head", F.left("term", F.lit(3)))
    pairs = words.join(known, "head").filter(tx.kin(F.col("word"), F.col("term"))).drop("head")
    return asked.join(pairs, "word").select("query_id", "word", "term")


def stem_groups(queries: DataFrame) -> DataFrame:
    """(query_id, word, root): the shortest word of the query that each of its words begins with."""
    asked = queries.select("query_id", F.array_distinct(tx.words(F.col("query"))).alias("w"))
    # all words a word begins with are prefixes of each other, so the least is the shortest
    rooted = F.transform("w", lambda x: F.struct(x.alias("word"), F.array_min(F.filter("w", lambda m: F.startswith(x, m))).alias("root")))
    return asked.select("query_id", F.explode(rooted).alias("g")).select("query_id", "g.word", "g.root")


def word_groups(queries: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, g, root), (g, term)): the groups of each query, its words of one root with all vocabulary words of their stem or kin.

    Queries of one wording share their groups: ``g`` is the hash of a group's terms, so a group's lines are read once.
    """
    terms = query_words(queries, vocabulary).join(stem_groups(queries), ["query_id", "word"]).select("query_id", "root", "term").distinct()
    listed = terms.groupBy("query_id", "root").agg(F.sort_array(F.collect_list("term")).alias("terms")).withColumn("g", F.xxhash64("terms"))
    grouped = checkpointed(listed.select("query_id", "g", "root", "terms"))
    return grouped.select("query_id", "g", "root"), grouped.select("g", F.explode("terms").alias("term")).distinct()


def scored(
    queries: DataFrame, post: DataFrame, keys: DataFrame, lengths: DataFrame, floor: float = 0.5, most: int | None = None, bonus: DataFrame | None = None
) -> DataFrame:
    """AG-03: (query_id, sid, source, score): summed information of the query words a line holds, over its length.

    ``post`` is (word, sid, source), ``keys`` the part of it where the word is a field name (TXT-16; repeats are allowed),
    ``lengths`` (sid, n_words).  Query words of which one begins another count once, over all lines of either, and
    ``CHANNEL`` times where the line holds one of them as its field name.  Lines under ``floor`` of the query's best
    score fall away (RK-03); with ``most`` also lines that cannot be among so many even with the greatest ``bonus`` (query_id, bonus)
    that may be added later.

    Frequent words are not looked up for every line.  The lines of each query's rarest groups are scored first; what their
    best guarantee is a bound that every result must reach.  The groups of least weight that together stay under it cannot make
    a result alone, so only lines of the other groups are summed, and of those only the few that could still reach the bound are
    scored in full.  No line that reaches the bound is left out.
    """
    of_query, terms = word_groups(queries, post)
    of_query = of_query.select("query_id", "g").distinct()
    # (g, sid, source, times): the lines of each different group
    known = terms.select("term").distinct()
    plain = post.join(known, post["word"] == known["term"], "left_semi").select("word", "sid", "source", F.lit(1).alias("times"))
    named = keys.join(known, keys["word"] == known["term"], "left_semi").select("word", "sid", "source", F.lit(CHANNEL).alias("times"))
    places = plain.unionByName(named)
    hits = checkpointed(terms.join(places, terms["term"] == places["word"]).groupBy("g", "sid", "source").agg(F.max("times").alias("times")))
    held = hits.groupBy("g").agg(F.count(F.lit(1)).alias("held"), F.max("times").alias("most"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("mean"))
    weight = checkpointed(of_query.join(held, "g").join(F.broadcast(totals), F.lit(True)).select(
        "query_id", "g", "held", "most", F.log(1 + F.col("n") / F.col("held")).alias("weight"), "mean"))
    # a line's groups in its own row
    lines = checkpointed(hits.groupBy("sid", "source").agg(F.collect_list(F.struct("g", "times")).alias("has")).join(lengths, "sid"))
    asks = weight.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("g", "weight"))).alias("by"), F.first("mean").alias("mean"))
    norm = 0.8 + 0.2 * F.greatest(F.col("n_words"), F.lit(1)) / F.col("mean")
    whole = F.aggregate("has", F.lit(0.0), lambda sum_, h: sum_ + h["times"] * F.coalesce(F.element_at("by", h["g"]), F.lit(0.0)))

    def summed(chosen: DataFrame) -> DataFrame:
        """(query_id, sid, part): what the chosen (query_id, g, weight) alone give each of their lines."""
        return chosen.join(hits.select("g", "sid", "times"), "g").groupBy("query_id", "sid").agg(F.sum(F.col("weight") * F.col("times")).alias("part"))

    rarest = Window.partitionBy("query_id").orderBy("held", "g")
    first = weight.withColumn("before", F.sum("held").over(rarest) - F.col("held")).filter(F.col("before") < FIRST_LINES).select("query_id", "g", "weight")
    tried = summed(first).join(lines, "sid").join(asks, "query_id").select("query_id", (whole / norm).alias("score"))
    bound = F.max("score") * floor
    if most is not None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
        tried = tried.withColumn("place", place).filter(F.col("place") <= most)
        if bonus is not None:
            tried = tried.join(bonus.groupBy("query_id").agg(F.max("bonus").alias("most_bonus")), "query_id", "left")
        behind = F.coalesce("most_bonus", F.lit(0.0)) if bonus is not None else F.lit(0.0)
        bound = F.greatest(bound, F.max(F.when(F.col("place") == most, F.col("score") - behind)))
    bounds = tried.groupBy("query_id").agg((bound - 0.001).alias("bound"))
    lightest = Window.partitionBy("query_id").orderBy(F.col("weight") * F.col("most"), "g").rowsBetween(Window.unboundedPreceding, 0)
    reach = checkpointed(weight.withColumn("upto", F.sum(F.col("weight") * F.col("most")).over(lightest)).join(bounds, "query_id").withColumn(
        "needed", F.col("upto") / (0.8 + 0.2 / F.col("mean")) >= F.col("bound")))
    rest = reach.groupBy("query_id").agg(F.coalesce(F.max(F.when(~F.col("needed"), F.col("upto"))), F.lit(0.0)).alias("rest"), F.first("bound").alias("bound"))
    able = summed(reach.filter("needed").select("query_id", "g", "weight")).join(lines, "sid").join(asks.join(rest, "query_id"), "query_id").filter(
        (F.col("part") + F.col("rest")) / norm >= F.col("bound"))
    score = F.when(F.col("rest") > 0, whole).otherwise(F.col("part")) / norm
    ranked = checkpointed(able.select("query_id", "sid", "source", F.round(score, 6).alias("score")))
    best = ranked.groupBy("query_id").agg(F.max("score").alias("best"))
    return ranked.join(best, "query_id").filter(F.col("score") >= floor * F.col("best")).drop("best")


def top(ranked: DataFrame, most: int = 6, tie: Column | None = None) -> DataFrame:
    """RK-02: the best rows of each query by score, then the tie column (the longer line first), then sid; pruned before the shuffle."""
    order = [F.col("score").desc(), *([tie] if tie is not None else []), F.col("sid")]
    by = Window.partitionBy("query_id").orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def name_bonus(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """AG-04: (query_id, source, bonus): ln(S/s) for each query word that s of S source names hold."""
    names = sources.select("source").distinct()
    word = names.select("source", F.explode(F.array_distinct(tx.words(tx.source_name(F.col("source"))))).alias("word"))
    count = names.agg(F.count(F.lit(1)).alias("all"))
    shared = word.groupBy("word").agg(F.count(F.lit(1)).alias("with")).join(F.broadcast(count), F.lit(True)).filter("`with` < `all`")
    bonus = shared.select("word", F.log(F.col("all") / F.col("with")).alias("bonus"))
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.words(F.col("query")))).alias("word"))
    return asked.join(word.join(bonus, "word"), "word").groupBy("query_id", "source").agg(F.sum("bonus").alias("bonus"))


def name_boost(ranked: DataFrame, queries: DataFrame, sources: DataFrame) -> DataFrame:
    """AG-04: the bonus of each line's source name on its score."""
    by = name_bonus(queries, sources)
    return ranked.join(by, ["query_id", "source"], "left").withColumn("score", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 6)).drop("bonus")


def tokenised(rows: DataFrame) -> DataFrame:
    """(sid, source, sentence, toks, words), made once and written."""
    toks = rows.select("sid", "source", "sentence", tx.tokens(F.col("sentence")).alias("toks"))
    return checkpointed(toks.withColumn("words", tx.content(F.col("toks"))))


def texts_of(rows: DataFrame) -> DataFrame:
    """(t, sentence, n, toks, words) of the different sentences, made once and written; ``n`` lines have each."""
    spark = rows.sparkSession
    # reading takes long and the texts are short, so they go to all cores, however few bytes they are
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    made = rows.select("sentence").repartition(parts, "sentence").groupBy("sentence").agg(F.count(F.lit(1)).alias("n")).withColumn("toks", tx.tokens(F.col("sentence")))
    return checkpointed(made.withColumn("words", tx.content(F.col("toks"))).withColumn("t", F.monotonically_increasing_id()))


def ranking(rows: DataFrame, queries: DataFrame, floor: float = 0.5, most: int | None = None) -> DataFrame:
    """RK-02, AG-02 .. AG-04: (query_id, sid, source, score, chars) of the lines over the floor, with the bonus of their sources' names.

    ``rows``: (sid, source, sentence), or what ``tokenised`` makes of them.
    """
    from cairn.operators.store import key_words

    known = rows if "toks" in rows.columns else tokenised(rows)
    post = known.select("sid", "source", F.explode(F.array_distinct("words")).alias("word"))
    lengths = known.select("sid", F.size("words").alias("n_words"), F.length("sentence").alias("chars"))
    bonus = checkpointed(name_bonus(queries, known))
    plain = scored(queries, post, key_words(known), lengths.select("sid", "n_words"), floor, most, bonus)
    named = plain.join(bonus, ["query_id", "source"], "left").withColumn("score", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 6)).drop("bonus")
    return named.join(lengths.select("sid", "chars"), "sid")


def where(rows: DataFrame, term: str) -> DataFrame:
    """JN-04: (source, lines): lines that hold every word of a term, up to inflection; a term without words has none.

    One scan decides each line by itself; only the counts of the sources are shuffled.
    """
    wanted = rows.sparkSession.range(1).select(F.array_distinct(tx.words(F.lit(term)))).first()[0]  # the words of one term
    if not wanted:
        return rows.select("source", F.lit(0).cast("long").alias("lines")).limit(0)
    # a word of the stem begins with the same letters, which must stand in the folded line: a plain test before the exact one
    letters = tx.fold(F.regexp_replace("sentence", r"\p{M}+", ""))
    near = rows
    for w in wanted:
        near = near.filter(F.contains(letters, F.lit(w[: tx.ROOT])))
    # the generator keeps the words from being made again for each wanted word
    held = near.select("source", F.explode(F.array(tx.words(F.col("sentence")))).alias("words"))
    for w in wanted:
        held = held.filter(tx.stem_held(F.lit(w), F.col("words")))
    return held.groupBy("source").agg(F.count(F.lit(1)).alias("lines"))


def census_pair(post: DataFrame, words: list[str]) -> DataFrame:
    """AG-05: the pair of words whose common lines span most sources; ties go to fewer lines, then by word."""
    held = post.filter(F.col("word").isin(*words))
    a, b = held.alias("a"), held.select(F.col("word").alias("other"), "sid").alias("b")
    pairs = a.join(b, "sid").filter("word < other").groupBy("word", "other").agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("lines"))
    return pairs.orderBy(F.col("sources").desc(), "lines", "word", "other").limit(1)


def census(queries: DataFrame, post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AG-05: ((query_id, first, second, sources, lines), (query_id, source, lines)): of the words of each query the two whose common lines span most sources.

    Of equals the pair with fewer lines, then the first by name; the second table tallies the lines of each source.  The lines of a pair are
    found from its rarer word, so a frequent word is never joined with another.  Queries whose words share no line have no row.
    """
    of_query, terms = word_groups(queries, post)
    hits = checkpointed(terms.join(post, terms["term"] == post["word"]).select("g", "sid", "source").distinct())
    held = hits.groupBy("g").agg(F.count(F.lit(1)).alias("held"))
    known = of_query.join(held, "g")
    a, b = (known.select("query_id", F.col("g").alias(f"g{i}"), F.col("root").alias(f"root{i}"), F.col("held").alias(f"held{i}")) for i in (1, 2))
    asked = a.join(b, "query_id").filter("root1 < root2")
    rare, other = (F.when(F.col("held1") <= F.col("held2"), F.col(x)).otherwise(F.col(y)) for x, y in (("g1", "g2"), ("g2", "g1")))
    asked = checkpointed(asked.select("query_id", "root1", "root2", rare.alias("rare"), other.alias("other")))
    pairs = asked.select("rare", "other").distinct()
    met = pairs.join(hits.withColumnRenamed("g", "rare"), "rare").join(hits.select(F.col("g").alias("other"), "sid"), ["other", "sid"])
    met = checkpointed(met.groupBy("rare", "other", "source").agg(F.count_distinct("sid").alias("lines")))
    sizes = met.groupBy("rare", "other").agg(F.count(F.lit(1)).alias("sources"), F.sum("lines").alias("lines"))
    best = asked.join(sizes, ["rare", "other"]).groupBy("query_id").agg(F.min(F.struct((-F.col("sources")).alias("s"), "lines", "root1", "root2", "rare", "other")).alias("b"))
    pair = best.select("query_id", F.col("b.root1").alias("first"), F.col("b.root2").alias("second"), (-F.col("b.s")).alias("sources"), F.col("b.lines").alias("lines"))
    tally = best.select("query_id", "b.rare", "b.other").join(met, ["rare", "other"]).select("query_id", "source", "lines")
    return pair, tally


def rrf(rankings: DataFrame) -> DataFrame:
    """RK-09: (key, score, place) of rankings (key, rank): summed 1/(60+rank), ties by key."""
    fused = rankings.groupBy("key").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "key")))


def rrf_by(rankings: DataFrame, query: str = "query_id") -> DataFrame:
    """Rank fusion for many queries at once."""
    fused = rankings.groupBy(query, "key").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), "key")))


def recency(lines: DataFrame, query: str = "query_id") -> DataFrame:
    """RK-10: newest first where all lines of a query are dated; ties keep their order; else no rows."""
    dated = lines.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.count("day").alias("d")).filter("n = d").select(query)
    by = Window.partitionBy(query).orderBy(F.col("day").desc(), "rank")
    return lines.join(dated, query).withColumn("recent", F.row_number().over(by))


def superseded(lines: DataFrame) -> DataFrame:
    """RK-06: of dated lines of one family and name with different numbers, the latest alone.

    ``lines``: (family, name, stamp array<int>, number, …).
    """
    latest = lines.groupBy("family", "name").agg(F.max("stamp").alias("latest"))
    return lines.join(latest, ["family", "name"]).filter(F.col("stamp") == F.col("latest")).drop("latest")


def interleave(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """RK-15: round-robin of two rankings (key, rank), each key once."""
    both = first.select("key", (2 * F.col("rank")).alias("turn")).unionByName(second.select("key", (2 * F.col("rank") + 1).alias("turn")))
    once = both.groupBy("key").agg(F.min("turn").alias("turn"))
    return once.withColumn("place", F.row_number().over(Window.orderBy("turn", "key"))).filter(F.col("place") <= most)


def find(
    rows: DataFrame, queries: DataFrame, most: int = 6, floor: float = 0.5, rerank: Callable | None = None, scope: DataFrame | None = None,
    dense: tuple[DataFrame, DataFrame] | None = None, measured: bool = True,
) -> DataFrame:
    """RK-01: (query_id, rank, sid, source, sentence, score) of the best lines of each query.

    ``rows``: (sid, source, sentence).  Scores with the bonus of named sources, cut to ``scope`` (query_id, source) where one is given
    (RK-08: a scope without a hit gives its lines by shared words), seats with caps for regions and sources, later statements before earlier
    ones, named sources first, one line for a measurement asked for; with ``dense`` (source vectors, query vectors) the ranking of meaning is fused in.
    ``rerank`` (UD-02) takes a query's texts and returns their order; one that is no permutation is ignored.
    ``measured=False`` leaves the line for a measurement out, which stands behind all others, so that a query's first line is the same.
    """
    from cairn.operators import answers, scan, seats, store

    known = None if scope is None and dense is None else tokenised(rows)
    queries = checkpointed(queries.select("query_id", "query"))
    held = scan.store_of(rows, queries, seats.SCAN)
    if scope is None and dense is None:
        own, best = scan.seated(rows, queries, most, floor, held)
        own = checkpointed(own)
        seated = own.drop("score").join(rows.select("sid", "sentence"), "sid")
    else:
        ranked = ranking(known, queries, floor)
        if scope is not None:
            inside = scope.select("query_id", "source").distinct()
            ranked = ranked.join(inside, ["query_id", "source"], "left_semi")
        full = checkpointed(ranked.join(rows.select("sid", "sentence"), "sid"))
        seated = seats.seats(full, most, order=F.col("chars").desc())
    if scope is not None:
        bare = inside.join(full.select("query_id").distinct(), "query_id", "left_anti").join(rows, "source")
        plain = answers.scoped(bare, queries, most).join(rows, "sid")
        by = Window.partitionBy("query_id").orderBy(F.col("shared").desc(), "sid")
        seated = seated.unionByName(plain.withColumn("seat", F.row_number().over(by)).select(*seated.columns))
    spoken = name_bonus(queries, rows).select("query_id", "source").distinct()
    placed = answers.named_first(seats.without_superseded(seated).withColumnRenamed("seat", "rank"), spoken)
    seated = checkpointed(placed.select("query_id", F.col("place").alias("seat"), "sid", "source", "sentence"))
    out = seated
    if measured:
        units = checkpointed(store.learned_quantities(held.texts, "sentence", longest=None, times="n"))
        # only questions that ask for a quantity look further down, under the floor
        asking = checkpointed(queries.join(seats.asks_quantity(queries, units).select("query_id"), "query_id", "left_semi"))
        deep = checkpointed(scan.best_lines(rows, asking, seats.SCAN, 0.0, held))
        extra = seats.measurement_seat(deep.join(rows.select("sid", "sentence"), "sid"), seated, asking, held.keys, units, held.bounds)
        out = seated.unionByName(extra.withColumn("seat", F.lit(most + 1)).select(*seated.columns))
    if dense is not None:
        out = fused_seats(out, full, dense, most)
    if scope is None and dense is None:
        scores = own.select("query_id", "sid", "score")
        if measured:  # a line from under the floor has no score
            over = deep.join(best, "query_id").filter(F.col("plain") >= floor * F.col("best"))
            scores = scores.unionByName(over.select("query_id", "sid", "score")).distinct()
    else:
        scores = full.select("query_id", "sid", "score")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("seat"))).join(
        scores, ["query_id", "sid"], "left").select("query_id", "rank", "sid", "source", "sentence", "score")
    if rerank is None:
        return out

    def again(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank").reset_index(drop=True)
        try:
            order = list(rerank(part["sentence"].tolist()))
        except Exception:
            order = []
        if sorted(order) == list(range(len(part))):
            part = part.iloc[order].assign(rank=range(1, len(part) + 1))
        return part

    return out.groupBy("query_id").applyInPandas(again, out.schema)


def fused_seats(seated: DataFrame, full: DataFrame, dense: tuple[DataFrame, DataFrame], most: int, sources: int = 5, lines: int = 24) -> DataFrame:
    """RK-11: seats fused by rank with the best lexical lines of the sources nearest in meaning; ``dense``: ((source, embedding), (query_id, query_vector))."""
    vectors, asked = dense
    close = near(vectors.withColumnRenamed("source", "vec_id"), asked, sources).select("query_id", F.col("vec_id").alias("source"), F.col("rank").alias("near"))
    inside = full.join(close, ["query_id", "source"])
    by = Window.partitionBy("query_id", "source").orderBy(F.col("score").desc(), "sid")
    some = inside.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= max(most, -(-lines // sources)))
    second = some.select("query_id", F.col("sid").alias("key"), F.row_number().over(Window.partitionBy("query_id").orderBy("near", "nth")).alias("rank"))
    order = rrf_by(seated.select("query_id", F.col("sid").alias("key"), F.col("seat").alias("rank")).unionByName(second)).filter(F.col("place") <= most)
    told = seated.select("query_id", "sid", "source", "sentence").unionByName(some.select("query_id", "sid", "source", "sentence")).distinct()
    return order.select("query_id", F.col("key").alias("sid"), F.col("place").alias("seat")).join(told, ["query_id", "sid"]).select("query_id", "seat", "sid", "source", "sentence")


def cosine(a: Column, b: Column) -> Column:
    """RK-14: cosine of two vectors; null where a length is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when((size(a) > 0) & (size(b) > 0), dot / (size(a) * size(b)))


#: Bytes of query vectors that are sent to the tasks at once.
BLOCK_BYTES = 32 << 20


def near(vectors: DataFrame, queries: DataFrame, most: int = 5, least: float = -1.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """RK-12: (query_id, vec_id, cosine, rank): exact nearest vectors of each query vector.

    Queries go to the vectors in blocks of at most ``block_bytes``, one pass over the vectors a block, so what is broadcast has a fixed
    bound however many queries there are.  A task multiplies its batch with the block and gives out its ``most`` best of each query.
    Vectors that are null, of length 0 or of another width than the query have no cosine.
    """
    spark = vectors.sparkSession
    kinds = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()]
    asked = queries.filter("query_vector is not null and size(query_vector) > 0").select("query_id", F.col("query_vector").cast("array<double>").alias("v"), F.size("query_vector").alias("width"))
    sizes = asked.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a width
    found = spark.createDataFrame([], f"query_id {kinds[0]}, vec_id {kinds[1]}, cosine double")
    for width, n in sizes:
        blocks = -(-n * width * 8 // block_bytes)
        for b in range(blocks):
            part = asked.filter((F.col("width") == width) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).select("query_id", "v").toPandas()
            found = found.unionByName(_nearest(vectors, part, width, most, least, kinds))
    by = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def _nearest(vectors: DataFrame, block: pd.DataFrame, width: int, most: int, least: float, kinds: list[str]) -> DataFrame:
    names = block["query_id"].to_numpy()
    matrix = np.array(block["v"].tolist(), dtype=float).reshape(len(block), width)
    sizes = np.linalg.norm(matrix, axis=1)
    names, matrix = names[sizes > 0], matrix[sizes > 0] / sizes[sizes > 0, None]
    sent = vectors.sparkSession.sparkContext.broadcast((names, matrix))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = sent.value
        for batch in batches:
            ids, rows = batch["vec_id"].to_numpy(), np.array(batch["embedding"].tolist(), dtype=float).reshape(len(batch), width)
            length = np.linalg.norm(rows, axis=1)
            ids, rows = ids[length > 0], rows[length > 0] / length[length > 0, None]
            order = np.argsort(ids, kind="stable")  # equal cosines go by id
            ids, close = ids[order], np.round(matrix @ rows[order].T, 6)
            best = np.argsort(-close, axis=1, kind="stable")[:, :most]
            got = np.take_along_axis(close, best, axis=1)
            keep = got >= least
            yield pd.DataFrame({"query_id": np.repeat(names, keep.sum(axis=1)), "vec_id": ids[best][keep], "cosine": got[keep]})

    fit = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == width)).select("vec_id", "embedding")
    return fit.mapInPandas(multiply, f"query_id {kinds[0]}, vec_id {kinds[1]}, cosine double")
