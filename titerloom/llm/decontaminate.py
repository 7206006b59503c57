"""Op 7: benchmark decontamination over a distributed positional inverted index.

1. Benchmark texts become windows of ``width`` words (a shorter text: one window).
2. One pass over the corpus counts the benchmark's words. A window with a word that the
   corpus lacks can't occur and is let go; the others rank their words, rarest first.
3. A second pass stores the index: postings (row, term, position) of each window's two
   rarest words, and a posting of END for each row at the place after its last word, which
   is the row's number of words.
4. Only the rarest word's postings meet the windows: position less offset is the start they
   speak for. The second list is then probed at start plus its own offset.
5. What survives is probed at all its other offsets, by the postings of the documents that
   still have a candidate; starts that every word of the window confirms are phrases.
6. Proximity: where the two rarest words lie within ``slop`` words more than the window,
   the other words' postings near by decide whether some span of that length holds them all.

Frequent words never make long lists: neither stored but for END, nor expanded. Word
lists and row keys are broadcast up to BROADCAST_ROWS narrow rows, and shuffled beyond;
texts of candidate documents alone meet candidates.

Defined cases: null or empty text has no words and no hit; null item ids are matched but
not listed or counted as items; benchmark rows without words have no window; repeated rows
get the same result each; ties of rarity go by offset and change no result; a very long
text is so many postings, never one list; an empty corpus has no rows and an empty
benchmark contaminates nothing; columns other than doc_id, text, item_id are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.llm.common import ascii_lower, bounded_broadcast, is_ascii, join_rows, materialize, one_of, text_hash

#: Rows of at most a few words each, some 100 bytes: about 20 MB.
BROADCAST_ROWS = 200_000
SEPARATORS = one_of("".join(chr(c) for c in range(128) if not chr(c).isalnum())) + "+"
#: Stands after a row's last word; no word is it, as words hold no control characters.
END = "\u0001"
ROW = ("doc_id", "thash")


def raw_words(text: Column) -> Column:
    """ASCII letters and digits and all non-ASCII characters make words. All-ASCII texts
    are lowered as a whole, which is quick; words of others keep their case as yet."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(F.when(is_ascii(text), F.lower(text)).otherwise(text), SEPARATORS), "")


def words_of(text: Column) -> Column:
    return F.when(is_ascii(F.coalesce(text, F.lit(""))), raw_words(text)).otherwise(F.transform(raw_words(text), ascii_lower))


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, phrase (the window's words, space-joined), words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    cut = items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), width).alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("phrase"), "words").distinct()


def tokens_of(docs: DataFrame, end: bool = False) -> DataFrame:
    """doc_id, thash, pos (from 0), word; with END after each row's last word if asked."""
    # Hash and split first: beside a generator they would be computed again for each token.
    words = raw_words(F.col("text"))
    rows = docs.select("doc_id", text_hash().alias("thash"), is_ascii(F.col("text")).alias("ascii"), (F.array_append(words, END) if end else words).alias("words"))
    tokens = rows.select("doc_id", "thash", "ascii", F.posexplode("words").alias("pos", "word"))
    return tokens.withColumn("word", F.when(F.col("ascii"), F.col("word")).otherwise(ascii_lower(F.col("word")))).drop("ascii")


def ranked_terms(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, len, kinds (distinct words), offset, word, rank (rarest first) and kind_rank (the
    same over distinct words) of the windows whose words all occur in docs."""
    terms = materialize(phrases.select("id", F.size("words").alias("len"), F.size(F.array_distinct("words")).alias("kinds"), F.posexplode("words").alias("offset", "word")), "terms")
    vocabulary = terms.select("word").distinct()
    counts = tokens_of(docs).select("word").join(bounded_broadcast(vocabulary, BROADCAST_ROWS), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("id").orderBy("n", "word", "offset")
    known = terms.join(counts, "word").withColumn("rank", F.row_number().over(rarest)).withColumn("kind_rank", F.dense_rank().over(Window.partitionBy("id").orderBy("n", "word")))
    present = known.withColumn("present", F.count(F.lit(1)).over(Window.partitionBy("id"))).where("present = len").drop("present", "n")
    return materialize(present, "ranked-terms")


def index_of(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index (doc_id, thash, term, pos) of every window's two rarest words and of END,
    and its terms (word, term); END is term -1."""
    indexed = terms.where("rank <= 2 or kind_rank <= 2").select("word").distinct()
    named = materialize(indexed.withColumn("term", F.monotonically_increasing_id()), "indexed-words")
    wanted = named.union(named.sparkSession.createDataFrame([(END, -1)], "word string, term long"))
    postings = tokens_of(docs, end=True).join(bounded_broadcast(wanted, BROADCAST_ROWS), "word").select(*ROW, "term", "pos")
    return materialize(postings, "postings"), named


def anchors_of(terms: DataFrame, named: DataFrame, rank: str) -> DataFrame:
    """id, len, kinds, term_1, off_1, term_2, off_2 (null where a window has one word)."""
    two = terms.where(F.col(rank) <= 2).join(bounded_broadcast(named, BROADCAST_ROWS), "word")
    of = lambda k: F.min(F.when(F.col(rank) == k, F.struct("offset", "term")))
    both = two.groupBy("id", "len", "kinds").agg(of(1).alias("a"), of(2).alias("b"))
    return materialize(both.select("id", "len", "kinds", F.col("a.term").alias("term_1"), F.col("a.offset").alias("off_1"), F.col("b.term").alias("term_2"), F.col("b.offset").alias("off_2")), "anchors")


def _met(x: DataFrame, y: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """x joined to y where they are of one row and fulfil `on`, a condition on x and y."""
    return x.alias("x").join(y.alias("y"), F.expr(f"x.doc_id <=> y.doc_id and x.thash = y.thash and {on}"), how)


def _rarest_places(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, thash, p and the window's anchors, for every posting of its rarest word."""
    return postings.withColumnRenamed("term", "term_1").join(bounded_broadcast(anchors, BROADCAST_ROWS), "term_1").withColumnRenamed("pos", "p")


def _second_lists(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    seconds = anchors.where("term_2 is not null").select(F.col("term_2").alias("term")).distinct()
    return postings.join(bounded_broadcast(seconds, BROADCAST_ROWS), "term", "left_semi").select(*ROW, "term", "pos")


def _candidate_tokens(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """tokens_of() the documents that have a candidate."""
    keys = materialize(candidates.select(*ROW).distinct(), "candidate-rows")
    rows = docs.select("doc_id", "text", text_hash().alias("thash"))
    keys = bounded_broadcast(keys, BROADCAST_ROWS)
    return tokens_of(_met(rows, keys, "true").select("doc_id", "text"))


def phrase_places(docs: DataFrame, phrases: DataFrame, terms: DataFrame, postings: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, thash, id, start, len of every occurrence of a window."""
    anchors = anchors_of(terms, named, "rank")
    starts = _rarest_places(postings, anchors).withColumn("start", F.col("p") - F.col("off_1")).where("start >= 0").drop("p")
    second = _second_lists(postings, anchors)
    both = starts.where("term_2 is not null")
    met = _met(both, second, "x.term_2 = y.term and x.start + x.off_2 = y.pos")
    left = met.unionByName(starts.where("term_2 is null")).select(*ROW, "id", "len", "start").distinct()
    left = materialize(left, "candidates")
    asked = left.join(bounded_broadcast(phrases.select("id", "words"), BROADCAST_ROWS), "id").select(*ROW, "id", "len", "start", F.posexplode("words").alias("offset", "word"))
    asked = asked.withColumn("pos", F.col("start") + F.col("offset"))
    tokens = _candidate_tokens(docs, left).distinct()
    agreed = _met(asked, tokens, "x.pos = y.pos and x.word = y.word")
    return materialize(agreed.groupBy(*ROW, "id", "len", "start").agg(F.count(F.lit(1)).alias("n")).where("n = len").drop("n"), "phrases")


def near_places(docs: DataFrame, phrases: DataFrame, terms: DataFrame, postings: DataFrame, named: DataFrame, found: DataFrame, slop: int) -> DataFrame:
    """doc_id, thash, id of every window all of whose distinct words lie, in any order, in some
    span of its own length and slop words more; those found as phrases need no second look."""
    anchors = anchors_of(terms, named, "kind_rank").withColumn("span", F.col("len") + slop)
    widest = anchors.agg(F.max("span")).first()[0] or 1
    block = lambda pos: F.floor(pos / widest).cast("int")
    three = F.explode(F.array(*[block(F.col("p")) + k for k in (-1, 0, 1)])).alias("block")
    places = _rarest_places(postings, anchors).select(*ROW, "id", "kinds", "span", "p", "term_2")
    both, second = places.where("term_2 is not null").select("*", three), _second_lists(postings, anchors).withColumn("block", block(F.col("pos")))
    met = _met(both, second, "x.term_2 = y.term and x.block = y.block and abs(x.p - y.pos) < x.span")
    left = met.drop("block").unionByName(places.where("term_2 is null")).select(*ROW, "id", "kinds", "span", "p").distinct()
    known = found.select(*ROW, "id").distinct()
    left = materialize(_met(left, known, "x.id = y.id", "left_anti"), "near-candidates")
    asked = left.join(bounded_broadcast(phrases.select("id", "words"), BROADCAST_ROWS), "id").select(*ROW, "id", "kinds", "span", "p", F.explode(F.array_distinct("words")).alias("word")).select("*", three)
    tokens = _candidate_tokens(docs, left).distinct().withColumn("block", block(F.col("pos")))
    seen = _met(asked, tokens, "x.word = y.word and x.block = y.block and abs(x.p - y.pos) < x.span", "inner").select("x.doc_id", "x.thash", "id", "kinds", "span", "p", "y.pos", "x.word")
    # At most 2 * span - 1 places stand around one anchor.
    around = seen.groupBy(*ROW, "id", "kinds", "span", "p").agg(F.collect_set(F.struct("pos", "word")).alias("at")).where(F.size("at") >= F.col("kinds"))
    whole = F.exists(F.sequence(F.col("p") - F.col("span") + 1, F.col("p")), lambda s: F.size(F.array_distinct(F.transform(F.filter("at", lambda x: x["pos"].between(s, s + F.col("span") - 1)), lambda x: x["word"]))) == F.col("kinds"))
    return materialize(around.where(whole).select(*ROW, "id").distinct().unionByName(known), "near")


def _items(found: DataFrame, windows: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, thash, item (text) of every item that has one of the windows found."""
    named = windows.where(F.col("item_id").isNotNull()).join(phrases.select("phrase", "id"), "phrase").select("id", F.col("item_id").cast("string").alias("item")).distinct()
    return found.select(*ROW, "id").distinct().join(named, "id").select(*ROW, "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int | None = None) -> DataFrame:
    """One row per document: doc_id, thash, n_words, n_hit, n_items, items (sorted strings),
    and n_near, the items with a window near together, if slop is given."""
    windows = materialize(windows_of(benchmark, width), "windows")
    phrases = materialize(windows.groupBy("phrase").agg(F.first("words").alias("words")).withColumn("id", F.monotonically_increasing_id()), "window-ids")
    terms = ranked_terms(docs, phrases)
    postings, named = index_of(docs, terms)
    places = phrase_places(docs, phrases, terms, postings, named)
    # Words covered: each start's longest window, less what earlier ones reach.
    starts = places.groupBy(*ROW, "start").agg((F.col("start") + F.max("len")).alias("end"))
    reached = F.max("end").over(Window.partitionBy(*ROW).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    cover = starts.withColumn("new", F.greatest(F.col("end") - F.greatest("start", F.coalesce(reached, F.lit(0))), F.lit(0))).groupBy(*ROW).agg(F.sum("new").cast("long").alias("n_hit"))
    items = _items(places, windows, phrases).groupBy(*ROW).agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = join_rows(cover, items, "left")
    near = []
    if slop is not None:
        n_near = _items(near_places(docs, phrases, terms, postings, named, places, slop), windows, phrases).groupBy(*ROW).agg(F.count(F.lit(1)).alias("n_near"))
        # Every phrase is near as well, so that near rows are all rows found, but for items without an id.
        found = join_rows(found.select(*ROW).union(n_near.select(*ROW)).distinct(), found, "left")
        found, near = join_rows(found, n_near, "left"), [F.coalesce("n_near", F.lit(0)).alias("n_near")]
    found = materialize(found, "found")
    rows = postings.where("term = -1").select(*ROW, F.col("pos").cast("long").alias("n_words"))
    return join_rows(rows, bounded_broadcast(found, BROADCAST_ROWS // 10), "left").select(
        *ROW,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.when(F.col("items").isNotNull(), F.size("items")).otherwise(0).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        *near,
    )
