"""Top-k text search for a table of queries: an inverted index whose postings are skipped by upper bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.functions.text import tokens
from adloom.sources.stored import dropped, stored

K1, B = 1.2, 0.75
#: Levels of impact that the postings of a token are kept in, and postings of one level that one task reads.
LEVELS, CHUNK = 32, 16_384
#: Query tokens that go to every executor, queries that a document's token meets on average, and (query, document) pairs of one
#: task, for whole documents to be scored where they are.
SENT_TOKENS, MET, TASK_PAIRS = 1 << 18, 256, 1 << 20


def query_tokens(queries: DataFrame, query_id: str, text: Column) -> DataFrame:
    return queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(tokens(text, "unigram"))).alias("token"))


def doc_terms(docs: DataFrame, doc_id: str, text: Column, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(d, token, tf) of tokens that some query has, and (d, n_tokens) of all documents with tokens."""
    words = tokens(text, "unigram")
    sizes = docs.select(F.col(doc_id).alias("d"), F.size(words).cast("bigint").alias("n_tokens")).where("n_tokens > 0")
    terms = docs.select(F.col(doc_id).alias("d"), F.explode(words).alias("token")).groupBy("d", "token").agg(F.count("*").alias("tf"))
    return terms.join(vocabulary, "token", "left_semi"), sizes


def index_terms(terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables from (d, token, weight, bonus): postings with their level and chunk, one row of bounds per token (df, most,
    levels), and the terms themselves.

    A posting's impact is weight + bonus. A token's impacts are cut into LEVELS even ranges, the highest first; `levels`
    lists those in use with their highest impact and number of chunks. No postings are sorted, and a token that most
    documents have is spread over levels and chunks.
    """
    impact = F.col("weight") + F.col("bonus")
    range_of = terms.groupBy("token").agg(F.count("*").alias("df"), F.max("weight").alias("most"), F.min(impact).alias("low"), F.max(impact).alias("high"))
    level = F.floor((F.col("high") - impact) * (LEVELS - 1) / F.greatest(F.col("high") - F.col("low"), F.lit(1))).cast("int")
    placed = terms.join(range_of.select("token", "low", "high"), "token").select("d", "token", "weight", "bonus", level.alias("level"))
    per_level = placed.groupBy("token", "level").agg(F.max(impact).alias("top"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    per_level = stored(per_level, "levels")
    listed = per_level.groupBy("token").agg(F.collect_list(F.struct("level", "top", "chunks")).alias("levels"))
    bounds = stored(range_of.select("token", "df", "most").join(listed, "token"), "bounds")
    chunk = F.pmod(F.xxhash64("d"), F.col("chunks")).cast("int")
    postings = stored(placed.join(per_level.select("token", "level", "chunks"), ["token", "level"]).select("token", "level", chunk.alias("chunk"), "d"), "postings")
    return postings, bounds, terms


def full_scores(pairs: DataFrame, asked: DataFrame, terms: DataFrame) -> DataFrame:
    """(q, d, score) of candidate pairs: each meets its query's tokens, and those the document's terms."""
    wanted = pairs.join(asked, "q").join(terms, ["d", "token"])
    return wanted.groupBy("q", "d").agg((F.sum("weight") + F.max("bonus")).alias("score"), F.count("*").alias("shared"))


def candidate_pairs(asked: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], k: int) -> DataFrame:
    """(q, d) of every document that can be among the k best of a query, and few others.

    Scores of each token's k documents of highest impact give a query's k-th best score so far. Its tokens are ordered
    from rare to frequent. A document first met at one token has at most that level's highest impact plus the highest
    weights of the tokens after it; levels that stay below the k-th best so far are not read. So a stop word's postings
    are read only by a query that has nothing better.
    """
    postings, bounds, terms = index
    by = Window.partitionBy("token").orderBy(F.desc(F.col("weight") + F.col("bonus")), "d")
    heads = terms.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).select("token", "d")
    heads = stored(heads.groupBy("token").agg(F.collect_list("d").alias("ds")), "heads")
    first = asked.join(heads, "token").select("q", F.explode("ds").alias("d")).distinct()
    ranked = full_scores(first, asked, terms).withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d")))
    reached = ranked.where(F.col("n") == k).select("q", F.col("score").alias("reached"))
    after = Window.partitionBy("q").orderBy("df", "token").rowsBetween(1, Window.unboundedFollowing)
    met = asked.join(bounds, "token").withColumn("rest", F.coalesce(F.sum("most").over(after), F.lit(0))).join(reached, "q", "left")
    read = F.filter("levels", lambda x: F.col("reached").isNull() | (x["top"] + F.col("rest") >= F.col("reached")))
    read = met.select("q", "token", F.inline(read)).select("q", "token", "level", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    return read.join(postings, ["token", "level", "chunk"]).select("q", "d").distinct()


def best_documents(asked: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(q, pos, d, score, shared): the k documents with the highest sum of weights plus bonus; lower ids first of equals.

    asked: (q, token), distinct. terms: (d, token, weight, bonus), whole numbers, one bonus a document.
    """
    asked, terms = stored(asked, "asked"), stored(terms, "terms")
    if terms.isEmpty():
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        return asked.sparkSession.createDataFrame([], f"q {kind(asked, 'q')}, pos int, d {kind(terms, 'd')}, score long, shared long")
    index = index_terms(terms)
    found = full_scores(stored(candidate_pairs(asked, index, k), "candidates"), asked, index[2])
    by = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    top = stored(found.withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= k).select("q", "pos", "d", "score", "shared"), "best")
    dropped(asked, *index)
    return top


def counted_terms(docs: DataFrame, doc_id: str, text: Column, vocabulary: DataFrame) -> DataFrame:
    """(d, n_tokens, token, tf) of the vocabulary's tokens, and one row with the token '' for every document with tokens.

    A small vocabulary goes to the documents, so that other tokens don't move.
    """
    held = docs.select(F.col(doc_id).alias("d"), tokens(text, "unigram").alias("words")).where(F.size("words") > 0)
    long = held.select("d", F.size("words").cast("bigint").alias("n_tokens"), F.explode(F.concat("words", F.array(F.lit("")))).alias("token"))
    known = vocabulary.unionByName(vocabulary.sparkSession.range(1).select(F.lit("").alias("token")))
    if vocabulary.count() <= SENT_TOKENS:
        known = F.broadcast(known)
    return long.join(known, "token", "left_semi").groupBy("d", "n_tokens", "token").agg(F.count("*").alias("tf"))


def scored_documents(asked: DataFrame, terms: DataFrame, k: int, parts: int) -> DataFrame:
    """(q, pos, d, score) as best_documents(), for few queries: a document's terms meet in one of the parts, where all queries
    that share one are scored; each part moves its k best of a query."""
    sums = terms.repartition(parts, "d").join(F.broadcast(asked), "token").groupBy("q", "d").agg(F.sum("weight").alias("score"))
    by = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    return stored(sums.withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= k).select("q", "pos", "d", "score"), "best")


def lexical_overlap_topk(queries: DataFrame, docs: DataFrame, k: int = 3, query_id: str = "query_id", doc_id: str = "doc_id", query_text: Column | None = None, doc_text: Column | None = None) -> DataFrame:
    """query, pos, doc, overlap, score: distinct shared tokens plus 0.001 per token of the document; lower ids first of equals.

    Ids are unique on both sides. Weights are thousandths: 1000 a token, and the number of tokens as bonus. Only tokens of
    the queries' vocabulary leave the documents.
    """
    asked = query_tokens(queries, query_id, F.col("text") if query_text is None else query_text)
    terms, sizes = doc_terms(docs, doc_id, F.col("text") if doc_text is None else doc_text, asked.select("token").distinct())
    weighted = terms.join(sizes, "d").select("d", "token", F.lit(1000).cast("bigint").alias("weight"), F.col("n_tokens").alias("bonus"))
    top = best_documents(asked, weighted, k)
    return top.select(F.col("q").alias(query_id), "pos", F.col("d").alias(doc_id), F.col("shared").alias("overlap"), F.round(F.col("score") / 1000.0, 6).alias("score"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 100, query_id: str = "query_id", doc_id: str = "doc_id", query_text: Column | None = None, doc_text: Column | None = None) -> DataFrame:
    """query, pos, doc, score by BM25 with k1 1.2, b 0.75 and idf ln(1 + (N - df + 0.5) / (df + 0.5)); lower ids first of equals.

    Ids are unique on both sides. A term counts in whole millionths, so that a score does not depend on the order of its
    terms and bounds are exact.
    """
    asked = stored(query_tokens(queries, query_id, F.col("text") if query_text is None else query_text), "asked")
    counted = stored(counted_terms(docs, doc_id, F.col("text") if doc_text is None else doc_text, asked.select("token").distinct()), "counted")
    terms, sizes = counted.where("token <> ''"), counted.where("token = ''")
    whole = sizes.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("mean_tokens"))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # one row a token of the queries
    frequency = terms.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(whole)).select("token", "df", idf.alias("idf"), "mean_tokens")
    frequency = stored(frequency, "frequency")
    met = asked.groupBy("token").agg(F.count("*").alias("n")).join(frequency, "token")
    found = met.agg(F.count("*").alias("known"), F.sum("n").alias("sent"), F.sum("df").alias("terms"), F.sum(F.col("df") * F.col("n")).alias("met")).first()
    few = found["known"] > 0 and found["sent"] <= SENT_TOKENS and found["met"] <= MET * found["terms"]
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_tokens")))
    weighted = terms.join(F.broadcast(frequency) if few else frequency, "token").select("d", "token", F.round(F.col("idf") * tf * 1e6).cast("bigint").alias("weight"))
    if few:
        pairs = min(found["met"], sizes.count() * asked.select("q").distinct().count())
        top = scored_documents(asked, weighted, k, -(-pairs // TASK_PAIRS))
    else:
        top = best_documents(asked, weighted.withColumn("bonus", F.lit(0).cast("bigint")), k)
    dropped(asked, counted, frequency)
    return top.select(F.col("q").alias(query_id), "pos", F.col("d").alias(doc_id), (F.col("score") / 1e6).alias("score"))
