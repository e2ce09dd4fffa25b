"""Benchmark decontamination by a positional inverted index (operator 6), in DataFrame functions only.

1. The index: one posting (text, position) per document word that any item holds, written once. Equal texts have equal keys and postings; copies are
   reduced to one, map-side first, as soon as postings meet.
2. Each window of 13 item words (a shorter item is one window) is a phrase. Its terms are ranked by how many postings they have. A window
   with a term that has none cannot occur.
3. Lists are intersected from the rarest term on: the postings of a window's rarest term, moved back by the term's offset, give the
   places where the item's first word would stand; postings of the second and third rarest must stand at their offsets from such a place.
4. What survives is an alignment (text, item, place). All words of the item are looked up at their places in the index;
   runs of 13 consecutive words found (or all words of a shorter item) are exact matches, and each word in one is hit.
5. Proximity: an item is near if some stretch of `SLOP` words of a text holds at least three quarters of the different words of one of
   its windows, in any arrangement; words that no document has count as missing. Of any such three quarters, MEET stand among the
   window's rarest quarter and MEET more, so these are looked up first, in tiles of two stretches that overlap by one, each a bit of
   its item's mask of a tile; only where those of one window meet are all words of the item read and every stretch looked at. Such
   items are counted apart and do not decide contamination.

The terms, windows and alignments are broadcast only if they are counted and small; beyond the bound the same joins
shuffle. Nothing is collected per term: a word that is a third of all words is counted map-side and its postings are read
where they were written.

Null, empty and blank texts have no words and hit nothing; such items have no window. Equal items are items of their own if their ids differ;
a null item_id is written as the empty string. Equal rows get equal results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import content_key, cut

WINDOW = 13
LEVELS = 3
SLOP = 2 * WINDOW
MEET = 3
PERCENT = 5
# Words of an item share the bits of a long when it has more.
BITS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# Rows of a table that may be broadcast: at most about 16 MB.
SMALL = 200_000


def words_of(text: Column) -> Column:
    """The words of a text, A to Z in lower case; no words for null."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    # A text of ASCII characters alone has a quick way to the same letters.
    lowered = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is counted and small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def item_terms(benchmark: DataFrame) -> DataFrame:
    """`item`, `item_id`, `j` (place in the item), `word`, `size` (words of the item), `need` (words of a window)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).select(
        F.xxhash64("item_id", "words").alias("item"), "item_id", F.size("words").alias("size"), F.posexplode("words").alias("j", "word")
    )
    return items.distinct().withColumn("need", F.least(F.col("size"), F.lit(WINDOW)))


def tokens(docs: DataFrame) -> DataFrame:
    """`k1`, `k2`, `pos`, `word` of every word of the texts."""
    # Keys selected beside the posexplode would be computed behind it, from the whole text for each of its words.
    keyed = docs.select(*content_key(F.col("text").cast("string")), "text")
    return keyed.select("k1", "k2", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))


def index(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The postings `k1`, `k2`, `pos`, `term` of the words in `words` (`word`, `term`), written to the shared folder."""
    return cut(tokens(docs).join(small(words), "word").select("k1", "k2", "pos", "term"), "postings")


def _ranked_windows(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """`item`, `w` (first word of the window), and its LEVELS rarest words as `t1`, `j1`, `t2`, `j2`, ...; a window all of
    whose words are postings. A short window repeats its last word."""
    placed = terms.join(counts, "term", "left").withColumn(
        "w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("j") - F.col("need") + 1), F.least(F.col("j"), F.col("size") - F.col("need"))))
    )
    packed = placed.groupBy("item", "w").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("j"), F.col("term")))).alias("ranked")
    )
    packed = packed.where(F.col("ranked")[0]["n"] > 0)
    columns = []
    for level in range(LEVELS):
        at = F.least(F.lit(level), F.size("ranked") - 1)
        entry = F.element_at("ranked", (at + 1).cast("int"))
        columns += [entry["term"].alias(f"t{level + 1}"), entry["j"].alias(f"j{level + 1}")]
    return packed.select("item", "w", *columns)


def _tiles(postings: DataFrame) -> DataFrame:
    """Each posting in the two tiles that hold it: tile t is the words from t * SLOP on, two stretches long."""
    t = F.floor(F.col("pos") / SLOP)
    return postings.withColumn("tile", F.explode(F.sequence(F.greatest(t - 1, F.lit(0)), t)))


def near(terms: DataFrame, postings: DataFrame, counts: DataFrame) -> DataFrame:
    """Proximity matches `k1`, `k2`, `item_id` of the items' `terms` (`item_terms` with `term`)."""
    first = F.sequence(F.greatest(F.lit(0), F.col("j") - F.col("need") + 1), F.least(F.col("j"), F.col("size") - F.col("need")))
    ranked = terms.join(counts, "term", "left").select("item", F.explode(first).alias("w"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term").alias("t"))
    ranked = ranked.groupBy("item", "w").agg(F.sort_array(F.collect_set("t"))["term"].alias("words"))
    ranked = ranked.withColumn("least", F.ceil(F.size("words") * 0.75).cast("int")).withColumn("meet", F.least("least", F.lit(MEET)))
    windows = cut(ranked, "windows")

    # A rare word is a bit by its first place in the item, so that words of one window seldom share one; where they do, the
    # window asks for as many bits fewer.
    bits = terms.groupBy("item", "term").agg(F.expr(f"shiftleft(1L, min(j) % {BITS})").alias("bit"))
    rare = F.explode(F.slice("words", F.lit(1), F.size("words") - F.col("least") + F.col("meet")))
    rare = cut(windows.select("item", "w", "meet", rare.alias("term")).join(bits, ["item", "term"]), "rarest")
    masks = rare.groupBy("item", "w", "meet").agg(F.bit_or("bit").alias("mask"), F.count(F.lit(1)).alias("n"))
    masks = masks.select("item", "mask", (F.col("meet") - F.col("n") + F.bit_count("mask")).alias("need"))
    masks = masks.groupBy("item").agg(F.collect_set(F.struct("mask", "need")).alias("masks"), F.min("need").alias("need"))
    masks = cut(masks, "masks")
    keys = rare.select("item", "term", "bit").distinct().join(masks.select("item", "need"), "item")
    keys = small(cut(keys, "rarest"))
    # A row holds all windows of its item: these are what is counted.
    masks = F.broadcast(masks) if windows.count() <= SMALL else masks
    fewest = small(cut(windows.groupBy("item").agg(F.min("least").alias("fewest")), "fewest"))
    # A text's postings are dealt to one task before they multiply by tiles and items, which then go nowhere to be counted.
    rarest = postings.join(small(cut(keys.select("term").distinct(), "rarest")), "term", "left_semi").repartition("k1", "k2")
    spots = _tiles(rarest).select("k1", "k2", "tile", "term").join(keys, "term")
    spots = spots.groupBy("k1", "k2", "item", "tile").agg(F.bit_or("bit").alias("seen"), F.min("need").alias("need"))
    spots = spots.where(F.bit_count("seen") >= F.col("need")).drop("need").join(masks.drop("need"), "item")
    spots = spots.where(F.expr("exists(masks, m -> bit_count(seen & m.mask) >= m.need)"))
    spots = cut(spots.select("k1", "k2", "item", "tile"), "spots")
    texts = small(cut(spots.select("k1", "k2").distinct(), "texts"))
    spots = small(spots)

    words = windows.select("item", "w", "least", F.explode("words").alias("term"))
    own = small(cut(words.select("item", "term").distinct(), "words"))
    there = _tiles(postings.join(texts, ["k1", "k2"], "left_semi")).join(spots, ["k1", "k2", "tile"]).join(own, ["item", "term"])
    # Copies of a text have equal postings: as a set they are one.
    there = there.groupBy("k1", "k2", "item", "tile").agg(F.collect_set(F.struct("pos", "term")).alias("found"))
    there = there.join(fewest, "item").where("size(array_distinct(found.term)) >= fewest")
    held = there.select("k1", "k2", "item", "found").join(windows.select("item", "words", "least"), "item")
    held = held.withColumn("found", F.expr("filter(found, f -> array_contains(words, f.term))"))
    within = "filter(found, q -> q.pos >= p.pos and q.pos < p.pos + {})".format(SLOP)
    dense = F.expr(f"exists(found, p -> size(array_distinct(transform({within}, q -> q.term))) >= least)")
    close = held.where("size(array_distinct(found.term)) >= least").where(dense).select("k1", "k2", "item").distinct()
    return close.join(terms.select("item", "item_id").distinct(), "item").select("k1", "k2", "item_id")


def match(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """Exact matches `k1`, `k2`, `item_id`, `pos` (a hit word), and what `near` reads."""
    terms = item_terms(benchmark)
    vocabulary = cut(terms.select("word").distinct().withColumn("term", F.xxhash64("word")), "terms")
    terms = cut(terms.withColumn("term", F.xxhash64("word")), "items")
    postings = index(docs, vocabulary)
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    windows = cut(_ranked_windows(terms, counts), "windows")

    found = None
    for level in range(1, LEVELS + 1):
        wanted = small(cut(windows.select(F.col(f"t{level}").alias("term")).distinct(), "wanted"))
        lists = postings.join(wanted, "term", "left_semi")
        if found is None:
            rarest = small(cut(windows.select("item", F.col("t1").alias("term"), F.col("j1").alias("j")).distinct(), "rarest"))
            hits = cut(lists.join(rarest, "term").select("k1", "k2", "item", "term", "j", (F.col("pos") - F.col("j")).alias("place")).distinct(), "hits")
            keyed = windows.select("item", "w", F.col("t1").alias("term"), F.col("j1").alias("j"), *(c for c in windows.columns if c[1:].isdigit() and int(c[1:]) > 1))
            # A place before the text's first word would cut the window short unless the window begins later in the item.
            found = hits.join(small(keyed), ["item", "term", "j"]).where("place + w >= 0").drop("term", "j")
        else:
            at = found.withColumn("pos", F.col("place") + F.col(f"j{level}")).withColumnRenamed(f"t{level}", "term")
            found = at.join(lists, ["k1", "k2", "pos", "term"], "left_semi").drop("pos", "term", f"j{level}")
        found = cut(found, "places")

    places = small(cut(found.select("k1", "k2", "item", "place").distinct(), "alignments"))
    lookup = places.join(terms.select("item", "j", "term", "need"), "item").withColumn("pos", F.col("place") + F.col("j"))
    texts = small(cut(places.select("k1", "k2").distinct(), "texts"))
    there = postings.join(texts, ["k1", "k2"], "left_semi").join(lookup, ["k1", "k2", "pos", "term"])
    # Copies of a text have equal postings: one of each goes on, found map-side first.
    there = there.select("k1", "k2", "item", "place", "j", "pos", "need").distinct()
    inside = Window.partitionBy("k1", "k2", "item", "place")
    runs = there.withColumn("run", F.col("j") - F.row_number().over(inside.orderBy("j")))
    long = runs.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("k1", "k2", "item", "place", "run")))
    names = terms.select("item", "item_id").distinct()
    exact = long.where("length >= need").select("k1", "k2", "item", "pos").distinct().join(small(cut(names, "names")), "item")
    return exact.select("k1", "k2", "item_id", "pos"), (terms, postings, counts)


def judge(docs: DataFrame, benchmark: DataFrame, proximity: bool = True) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_hit`, `n_items`, `items_sha256`, `contaminated`, and with `proximity`
    `n_near`, the items that are near (see 5), exact matches among them."""
    exact, context = match(docs, benchmark)
    hit = exact.groupBy("k1", "k2", "pos").agg(F.collect_set("item_id").alias("items"))
    hit = hit.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    found = hit
    if proximity:
        close = near(*context).groupBy("k1", "k2").agg(F.countDistinct("item_id").alias("n_near"))
        found = hit.join(close, ["k1", "k2"], "full")
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *content_key(F.col("text").cast("string")),
        F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"),
    )
    items = F.sort_array(F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return own.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (100 * n_hit >= PERCENT * F.col("n_words"))).alias("contaminated"),
        *([F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")] if proximity else []),
    )


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The keys `k1`, `k2` (`common.content_key`) of the texts that are contaminated."""
    own = docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hit = match(own, benchmark)[0].groupBy("k1", "k2").agg(F.countDistinct("pos").alias("n_hit"))
    size = own.select(*content_key(F.col("text")), F.size(words_of(F.col("text"))).alias("n_words"))
    return hit.join(size, ["k1", "k2"]).where(100 * F.col("n_hit") >= PERCENT * F.col("n_words")).select("k1", "k2").distinct()
