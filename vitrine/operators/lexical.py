"""Lexical retrieval: weighted fields, AND / OR / NOT / phrase queries, and a trigram fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import or_else
from vitrine.operators.filters import is_active
from vitrine.operators.sizes import BROADCAST_ROWS, at_most, small_side
from vitrine.session import cut_lineage

FIELD_WEIGHTS = (("a", 1.0), ("b", 0.4), ("c", 0.2), ("d", 0.1))
FALLBACK_HITS = 5
TRIGRAM_FLOOR = 0.35
# A short list of English function words, left out of the index and of the queries.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")


def lexemes(text: Column) -> Column:
    """Lower-case words without stop words, final plural s dropped from words longer than three letters."""
    words = F.filter(F.split(F.lower(or_else(text, "")), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.transform(words, lambda w: F.regexp_replace(w, r"^(.{2,}[^s])s$", "$1"))


def search_fields(p) -> dict[str, Column]:
    """Token arrays by weight class: names, categories and types, attributes, free text."""
    m = p["metadata"]
    words = lambda *cs: lexemes(F.concat_ws(" ", *cs))
    return {
        "a": words(p["product_name"]),
        "b": words(p["normalized_main_category"], p["normalized_subcategory"], p["subcategory"], m["product_type"], m["product_family"]),
        "c": words(m["primary_colour"], F.concat_ws(" ", m["secondary_colours"]), F.concat_ws(" ", m["style"]), F.concat_ws(" ", m["hashtags"])),
        "d": words(p["description"], p["brand"], m["caption"]),
    }


def index_products(products: DataFrame) -> DataFrame:
    """(id, category_id, a, b, c, d, words, doc): the searchable form of each active product.

    Store it as a table when the catalog is searched often; every query then starts from it.
    """
    active = products.where(is_active(F.col("catalog_status")))
    fields = search_fields(active)
    rows = active.select("id", "category_id", *[c.alias(n) for n, c in fields.items()])
    text = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return rows.withColumns({
        "words": F.array_distinct(F.concat("a", "b", "c", "d")),
        "doc": F.concat_ws("|", *[text(F.col(n)) for n in fields]),
    })


def parse_search(query: Column) -> Column:
    """array<struct(must array<string>, must_not array<string>)>: one entry per OR alternative.

    A quoted phrase is one entry of several words; a leading minus excludes what follows it.
    """
    parts = lambda alternative: F.regexp_extract_all(alternative, F.lit(r'(-?"[^"]*"|[^\s"]+)'), F.lit(1))
    phrase = lambda part: F.array_join(lexemes(part), " ")
    kept = lambda ps, negative: F.array_distinct(F.filter(F.transform(F.filter(
        ps, lambda x: x.startswith("-") if negative else ~x.startswith("-")), phrase), lambda x: x != ""))
    alternatives = F.split(F.concat(F.lit(" "), or_else(query, ""), F.lit(" ")), r"(?i)\s+or\s+(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
    return F.filter(
        F.transform(alternatives, lambda a: F.struct(kept(parts(a), False).alias("must"), kept(parts(a), True).alias("must_not"))),
        lambda s: F.size(s["must"]) > 0)


def full_text_hits(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(qid, id, similarity, rank): products matching all words of an alternative and none it excludes.

    Queries that ask for the same words in the same scope, as most of a search log does, are matched once and share the
    result. Products that hold the asked terms alike in one category score alike, so they are one kind: alternatives meet
    kinds, by their rarest term only, and of a kind only its first k products can be returned.
    """
    asked = queries.select("qid", "scope", F.posexplode(parse_search(F.col("query"))).alias("nth", "alt")).select(
        "qid", "nth", "scope", F.array_sort("alt.must").alias("must"), F.array_sort("alt.must_not").alias("must_not"))
    asked = asked.withColumn("ask", F.sha2(F.to_json(F.struct("must", "must_not", "scope")), 256))
    alternatives = asked.select("ask", "must", "must_not", "scope").dropDuplicates(["ask"])
    members = product_kinds(alternatives, index, k)
    kinds = members.groupBy("kind").agg(F.first("category_id").alias("category_id"), F.first("held").alias("held"), F.min("id").alias("first_id"))
    wanted = alternatives.select("ask", F.explode("must").alias("term"))
    frequency = kinds.select(F.explode(F.map_keys("held")).alias("term")).groupBy("term").count()
    anchor = (
        wanted.join(frequency, "term", "left")
        .groupBy("ask").agg(F.min_by("term", F.struct(or_else(F.col("count"), 0), "term")).alias("anchor")))
    anchored = alternatives.join(anchor, "ask")
    if at_most(alternatives, BROADCAST_ROWS):
        anchored = F.broadcast(anchored)
    rows = kinds.withColumn("anchor", F.explode(F.map_keys("held"))).join(anchored, "anchor")
    has = lambda t: F.map_contains_key("held", t)
    in_scope = F.col("scope").isNull() | or_else(F.array_contains("scope", F.col("category_id")), False)
    matched = rows.where(in_scope & F.forall("must", has) & ~F.exists("must_not", has))
    total = F.aggregate("must", F.lit(0.0), lambda acc, t: acc + F.element_at("held", t))
    scored = matched.select("ask", "kind", "first_id", F.bround(total, 9).alias("similarity"))
    # Each better kind holds a better product, so the k best products are of the k best kinds; and a product among
    # the k best of a query is among the k best of the alternative it scores highest in.
    best_kinds = _first(scored, "ask", "first_id", k).select("ask", "kind", "similarity")
    heads = _first(best_kinds.join(members.select("kind", "id"), "kind").select("ask", "id", "similarity"), "ask", "id", k)
    best = asked.select("qid", "ask").join(heads, "ask").groupBy("qid", "id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def product_kinds(alternatives: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(kind, id, category_id, held): the products with an asked term, cut to the first k of each kind.

    ``held`` maps the terms of all alternatives that a product holds to their weight in it; a kind is a category and a ``held``.
    """
    terms = alternatives.select(F.explode(F.concat("must", "must_not")).alias("term")).distinct()
    terms = terms.withColumn("word", F.substring_index("term", " ", 1))
    met = index.withColumn("word", F.explode("words")).join(small_side(terms), "word")
    met = met.where(F.contains(F.col("doc"), F.concat(F.lit(" "), F.col("term"), F.lit(" "))))
    weighed = met.select("id", "category_id", F.xxhash64("doc").alias("row"), F.struct("term", term_weight(F.col("term")).alias("w")).alias("t"))
    held = weighed.groupBy("id", "category_id", "row").agg(F.array_sort(F.collect_set("t")).alias("held"))
    kind = F.sha2(F.to_json(F.struct("held", "category_id")), 256)
    spot = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    kept = held.withColumn("kind", kind).withColumn("_spot", spot).where(F.col("_spot") <= k)
    return cut_lineage(kept.select("kind", "id", "category_id", F.map_from_entries("held").alias("held")))


def _first(rows: DataFrame, group: str, then: str, k: int) -> DataFrame:
    """The k rows of a group with the highest similarity, the smaller ``then`` first among equals."""
    spot = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("similarity"), then))
    return rows.withColumn("_spot", spot).where(F.col("_spot") <= k).drop("_spot")


def term_weight(term: Column) -> Column:
    """The frequency of a term per field, weighted by the field; a phrase counts once per field."""
    total = F.lit(0.0)
    for name, weight in FIELD_WEIGHTS:
        single = F.size(F.filter(F.col(name), lambda w: w == term))
        phrase = F.contains(F.concat(F.lit(" "), F.array_join(F.col(name), " "), F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" "))).cast("int")
        total = total + F.when(F.contains(term, F.lit(" ")), phrase).otherwise(single) * F.lit(weight)
    return total


def weighted_lexical_rank(must: Column) -> Column:
    """Sum over the query terms of their weight in the product."""
    return F.aggregate(must, F.lit(0.0), lambda acc, t: acc + term_weight(t))


# ---------------------------------------------------------------- trigrams


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(or_else(text, "")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(needle: Column, text: Column) -> Column:
    """Best Jaccard similarity of the needle's trigrams with those of a run of consecutive words of the text."""
    words = F.filter(F.split(F.lower(or_else(text, "")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    wanted = trigrams(needle)
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def similarity(run: Column) -> Column:
        grams = trigrams(F.array_join(run, " "))
        shared = F.size(F.array_intersect(wanted, grams))
        return shared / (F.size(wanted) + F.size(grams) - shared)

    runs = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(i, F.greatest(n, i)), lambda j: F.slice(words, i, j - i + 1))))
    best = F.array_max(F.transform(runs, similarity))
    return F.when((n > 0) & (F.size(wanted) > 0), best).otherwise(0.0)


def trigram_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(query, name, similarity) of all pairs above the floor, for distinct ``texts`` (query) and ``names`` (name).

    A set-similarity join with prefixes. Above the floor a name holds more than floor x n of a text's n trigrams, so it
    holds one of the text's ``n - floor(floor x n)`` rarest: only those are keys, in order of their frequency among the
    names. A pair met there has to share enough trigrams in all before runs of words are compared. No pair is lost.
    """
    postings = names.select("name", F.explode(trigrams(F.col("name"))).alias("gram"))
    frequency = postings.groupBy("gram").agg(F.count("*").alias("n"))
    known = texts.select("query", F.explode(trigrams(F.col("query"))).alias("gram")).join(frequency, "gram", "left")
    ranked = known.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(or_else(F.col("n"), 0).alias("n"), "gram"))).alias("grams"))
    needed = lambda size: F.floor(size * int(100 * TRIGRAM_FLOOR) / 100)
    size = F.size("grams")
    prefix = F.slice("grams", F.lit(1), (size - needed(size)).cast("int"))
    keys = ranked.select("query", F.explode(F.filter(prefix, lambda g: g["n"] > 0)).alias("g")).select("query", "g.gram")
    met = keys.join(postings, "gram").select("query", "name").distinct()
    wanted = trigrams(F.col("query"))
    near = met.where(F.size(F.array_intersect(wanted, trigrams(F.col("name")))) > needed(F.size(wanted)))
    return near.withColumn("similarity", trigram_similarity(F.col("query"), F.col("name"))).where(F.col("similarity") > TRIGRAM_FLOOR)


def trigram_hits(queries: DataFrame, products: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Trigram matches above the floor for queries with few full-text hits, filling up to k.

    Similarity is computed between distinct query texts and distinct names, found through their rarest trigrams.
    Products of a category that are found by one name, or by one brand, score no less than it: only the first k +
    FALLBACK_HITS of them can be returned by it, and the others are cut before the join back.
    """
    hits = found.groupBy("qid").agg(F.count("*").alias("n_found"))
    few = queries.join(hits, "qid", "left").withColumn("n_found", or_else(F.col("n_found"), 0)).where(F.col("n_found") < FALLBACK_HITS)
    active = products.where(is_active(F.col("catalog_status")))
    spot = F.row_number().over(Window.partitionBy("name", "category_id").orderBy("id"))
    named = lambda column: active.select("id", F.col(column).alias("name"), "category_id").where("name IS NOT NULL").withColumn(
        "_spot", spot).where(F.col("_spot") <= k + FALLBACK_HITS).drop("_spot")
    shortlist = cut_lineage(named("product_name").union(named("brand")).distinct())
    names = shortlist.select("name").distinct()
    near = trigram_pairs(few.select("query").distinct(), names)
    scored = few.join(near, "query").select("qid", "scope", "n_found", "name", "similarity")
    pairs = shortlist.join(scored, "name")
    in_scope = F.col("scope").isNull() | or_else(F.array_contains("scope", F.col("category_id")), False)
    best = pairs.where(in_scope).groupBy("qid", "id", "n_found").agg(F.max("similarity").alias("similarity"))
    fresh = best.join(found.select("qid", "id"), ["qid", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= F.lit(k) - F.col("n_found")).withColumn(
        "rank", (F.col("rank") + F.col("n_found")).cast("int")).drop("n_found")


def lexical_search(queries: DataFrame, products: DataFrame, k: int = 100, index: DataFrame | None = None) -> DataFrame:
    """(qid, id, similarity, rank, source): full-text hits, then trigram hits for queries with fewer than five.

    Pass a stored ``index_products`` table as ``index`` to leave out the reading of all texts. Queries of equal text and
    scope are answered once. The hits, at most k per text and scope, are written once because the fallback needs them
    three times.
    """
    queries = queries if "scope" in queries.columns else queries.withColumn("scope", F.lit(None).cast("array<bigint>"))
    asked = queries.withColumn("ask", F.sha2(F.to_json(F.struct("query", "scope")), 256))
    texts = cut_lineage(asked.select(F.col("ask").alias("qid"), "query", "scope").dropDuplicates(["qid"]))
    index = index_products(products) if index is None else index
    hits = cut_lineage(full_text_hits(texts, index, k))
    filled = trigram_hits(texts, products, hits, k)
    found = hits.withColumn("source", F.lit("text")).unionByName(filled.withColumn("source", F.lit("trigram")))
    return asked.select("qid", "ask").join(found.withColumnRenamed("qid", "ask"), "ask").drop("ask")
